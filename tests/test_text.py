import pytest
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.audio import json_command


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_strip_tags(spark):
    x = ["<|zh|><|NEUTRAL|><|Speech|><|withitn|>你好世界", "<|zh|>hello<|en|>world<|withitn|>!", "a<|x|>b<|y|>c", "plain", "", None]
    assert one(spark, T.strip_tags(F.col("x")), *x) == ["你好世界", "helloworld!", "abc", "plain", "", None]


def test_greedy_variant_eats_text_between_tags(spark):
    assert one(spark, T.strip_tags_greedy(F.col("x")), "a<|x|>b<|y|>c") == ["ac"]


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("x")), "<|zh|>滨海, new-Town 7!", "a_b c") == ["滨海NEWTOWN7", "A_BC"]


def test_split_and_join_mixed(spark):
    assert one(spark, T.split_mixed(F.col("x")), "hello你好 world 3个") == [["hello", "你", "好", "world", "3", "个"]]
    assert one(spark, T.join_mixed(T.split_mixed(F.col("x"))), "hello你好 world don't") == ["hello你好 world don't"]


def test_char_tokens(spark):
    assert one(spark, T.char_tokens(F.col("x")), "a b") == [["a", "<space>", "b"]]
    assert one(spark, T.char_tokens(F.col("x"), ("<unk>",)), "a<unk>b") == [["a", "<unk>", "b"]]
    assert one(spark, T.char_tokens(F.col("x"), ("<unk>",), True), "a<unk>b") == [["a", "b"]]
    assert one(spark, T.chars_to_text(T.char_tokens(F.col("x"))), "a b") == ["a b"]


def test_detokenise(spark):
    assert one(spark, T.detokenise(F.col("x")), ["<|zh|>", "▁hel", "lo", "▁world"], schema="x array<string>") == ["hello world"]


def plain_rich(s):
    """The rendering rule, said row by row."""
    count = {}
    for tag, _ in T.RENDERED:
        count[tag] = s.count(tag)
        s = s.replace(tag, "")
    best = "<|NEUTRAL|>"
    for tag, _ in T.EMOTIONS:
        best = tag if count[tag] > count[best] else best
    s = "".join(sign for tag, sign in reversed(T.EVENTS) if count[tag]) + s + dict(T.EMOTIONS)[best]
    for sign in T.EMOTION_SIGNS + T.EVENT_SIGNS:
        s = s.replace(" " + sign, sign).replace(sign + " ", sign)
    return s.strip(" ")


RICH = ["<|en|><|HAPPY|><|BGM|>hi there <|Laughter|>", "<|HAPPY|><|SAD|>tie", "<|SAD|><|SAD|><|HAPPY|>x", "<|Cough|><|Sneeze|>y", "none", "", "<|nospeech|><|Event_UNK|>"]


def test_render_rich(spark):
    assert one(spark, T.render_rich(F.col("x")), *RICH) == [plain_rich(x) for x in RICH]
    assert one(spark, T.render(F.col("x")), "<|Cough|>a<|nospeech|><|Event_UNK|>") == ["😷a❓"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("<|zh|><|HAPPY|>a<|en|><|HAPPY|>b", "ab😊"),  # the emotion at a seam is shown once
        ("<|BGM|>a<|en|><|BGM|>b", "🎼a🎼b"),  # the first part's event isn't known, as a blank is put before it
        ("<|zh|><|BGM|>a<|en|><|BGM|>b", "🎼ab"),
        ("<|en|><|BGM|>a<|en|><|BGM|>b<|en|><|BGM|>c", "🎼ab🎼c"),  # a cut part has no event of its own
        ("<|zh|>a<|en|><|en|>b", "ab"),
        ("<|zh|>The.<|en|>x", "x"),
    ],
)
def test_merge_rendered(spark, text, want):
    got = one(spark, T.merge_rendered(F.transform(T.split_languages(F.col("x")), T.render_rich)), text)[0]
    assert got == want


def test_display_width(spark):
    assert one(spark, T.display_width(F.col("x")), "abc", "你好a", "", "！") == [3, 5, 0, 2]


def test_commands_and_formats(spark):
    x = ['{"type": "eof"}', '  {"type": "EOF"}  ', "  RESET \n", '{"type": "eof"', '{"type": "eof"}}', '"eof"', "[1]"]
    assert one(spark, json_command(F.col("x")), *x) == ["eof", "eof", "reset", "", "", '"eof"', "[1]"]
    assert one(spark, T.format_of(F.col("x")), "/?format=INT16", "/?format=float64", "/", "ws://h/p?a=1&format=float32") == ["int16", "float32", "float32", "float32"]


def test_clip_tail(spark):
    df = spark.createDataFrame([("abc",), ("abcdefgh",), ("你好世界",), ("a你b好c",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clip_tail(F.col("t"), 5)).collect()] == ["abc", "…efgh", "…世界", "…b好c", "", None]
    assert [r[0] for r in df.select(T.clip_tail(F.col("t"), 4)).collect()] == ["abc", "…fgh", "…界", "…好c", "", None]
    assert df.select(T.clip_tail(F.col("t"), 1)).collect()[1][0] == "…"


def test_commands_and_formats(spark):
    df = spark.createDataFrame([(' {"type": "EOF"} ',), (" Reset ",)], "t string")
    assert [r[0] for r in df.select(T.command_of(F.col("t"))).collect()] == [' {"type": "EOF"} ', "reset"]
    urls = spark.createDataFrame([("/?format=INT%31%36",), ("/?format=%zz",), ("/",)], "u string")
    assert [r[0] for r in urls.select(T.format_of(F.col("u"))).collect()] == ["int16", "float32", "float32"]
