"""Transcript text as column expressions: tags, normal forms, mixed-script tokens, emoji rendering, cell width."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: One rich tag, ``<|...|>``.
TAG = r"<\|[^|]*\|>"

# Tags and what they are rendered as, in the order in which they are replaced.
RENDERED = (
    ("<|nospeech|><|Event_UNK|>", "❓"), ("<|zh|>", ""), ("<|en|>", ""), ("<|yue|>", ""), ("<|ja|>", ""), ("<|ko|>", ""), ("<|nospeech|>", ""),
    ("<|HAPPY|>", "😊"), ("<|SAD|>", "😔"), ("<|ANGRY|>", "😡"), ("<|NEUTRAL|>", ""), ("<|BGM|>", "🎼"), ("<|Speech|>", ""), ("<|Applause|>", "👏"),
    ("<|Laughter|>", "😀"), ("<|FEARFUL|>", "😰"), ("<|DISGUSTED|>", "🤢"), ("<|SURPRISED|>", "😮"), ("<|Cry|>", "😭"), ("<|EMO_UNKNOWN|>", ""),
    ("<|Sneeze|>", "🤧"), ("<|Breath|>", ""), ("<|Cough|>", "😷"), ("<|Sing|>", ""), ("<|Speech_Noise|>", ""), ("<|withitn|>", ""), ("<|woitn|>", ""),
    ("<|GBG|>", ""), ("<|Event_UNK|>", ""),
)
#: Emotions in order of precedence, and events; the two tables give a cough different emoji.
EMOTIONS = (("<|HAPPY|>", "😊"), ("<|SAD|>", "😔"), ("<|ANGRY|>", "😡"), ("<|NEUTRAL|>", ""), ("<|FEARFUL|>", "😰"), ("<|DISGUSTED|>", "🤢"), ("<|SURPRISED|>", "😮"))
EVENTS = (("<|BGM|>", "🎼"), ("<|Speech|>", ""), ("<|Applause|>", "👏"), ("<|Laughter|>", "😀"), ("<|Cry|>", "😭"), ("<|Sneeze|>", "🤧"), ("<|Breath|>", ""), ("<|Cough|>", "🤧"))
LANGUAGES = ("<|zh|>", "<|en|>", "<|yue|>", "<|ja|>", "<|ko|>", "<|nospeech|>")
EMOTION_SIGNS = "😊😔😡😰🤢😮"
EVENT_SIGNS = "🎼👏😀😭🤧😷"
@lru_cache(1)
def wide_ranges() -> tuple[tuple[int, int], ...]:
    """First and last code points of the runs that Unicode calls wide or fullwidth (East Asian width W, F)."""
    wide = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.east_asian_width(chr(c)) in "WF"]
    starts = [c for k, c in enumerate(wide) if not k or wide[k - 1] != c - 1]
    ends = [c for k, c in enumerate(wide) if k == len(wide) - 1 or wide[k + 1] != c + 1]
    return tuple(zip(starts, ends, strict=True))


@lru_cache(1)
def wide() -> str:
    """A character class of those that take two terminal cells."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in wide_ranges()) + "]"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def strip_tags_greedy(text: Column) -> Column:
    """The older variant: on a line, everything from the first tag to the last goes."""
    return F.regexp_replace(text, r"<\|.*\|>", "")


def normalize(text: Column, letters: str = r"\p{L}\p{N}_") -> Column:
    """Scoring's normal form: no tags, only ``letters``, upper case."""
    return F.upper(F.regexp_replace(strip_tags(text), f"[^{letters}]", ""))


#: Bands of the edit distance, in edits, that are tried before the whole table.
BANDS = (8, 64, 512)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by characters. Bands around the diagonal are tried from narrow to wide, so texts with d edits in n
    characters cost about n * d steps, not n * n."""
    found = F.levenshtein(a, b)
    for band in reversed(BANDS):
        found = F.coalesce(F.nullif(F.levenshtein(a, b, band), F.lit(-1)), found)
    return found


def split_mixed(text: Column) -> Column:
    """Tokens of mixed text: runs of ASCII, and each other character by itself; white space separates."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(r"([\x21-\x7F\x00-\x1F]+|[^\x00-\x7F])"), 1)


def is_english(token: Column) -> Column:
    return token.rlike("^[a-zA-Z']+$")


def language_runs(tokens: Column) -> Column:
    """Runs of English and of other tokens of an array, as structs (run, english, tokens) numbered from 1; null for a null array."""

    def runs(own: Column) -> Column:
        words, english = own["words"], own["english"]
        turns = F.transform(english, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(english, i - 1)), i))
        return let(F.filter(turns, lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda at, k: _run(words, english, starts, at, k)))

    return let(tokens, lambda words: let(F.struct(words.alias("words"), F.transform(words, is_english).alias("english")), runs))


def _run(words: Column, english: Column, starts: Column, at: Column, k: Column) -> Column:
    stop = F.coalesce(F.get(starts, k + 1), F.size(words))
    return F.struct((k + 1).cast("long").alias("run"), F.get(english, at).alias("english"), F.slice(words, at + 1, stop - at).alias("tokens"))


def join_mixed(tokens: Column) -> Column:
    """Tokens as a line: a blank before English ones only."""
    return F.trim(F.array_join(F.transform(tokens, lambda t: F.when(is_english(t), F.concat(F.lit(" "), t)).otherwise(t)), ""))


def char_tokens(text: Column, symbols: tuple[str, ...] = (), remove_symbols: bool = False, space: str = "<space>") -> Column:
    """Characters, blanks by name; the given symbols stay whole or are removed."""
    quoted = "|".join(f"\\Q{s}\\E" for s in symbols)
    found = F.regexp_extract_all(text, F.lit(f"(?s)({quoted + '|' if symbols else ''}.)"), 1)
    if symbols and remove_symbols:
        found = F.filter(found, lambda t: ~t.isin(*symbols))
    return F.transform(found, lambda t: F.when(t == " ", space).otherwise(t))


def chars_to_text(tokens: Column, space: str = "<space>") -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t == space, " ").otherwise(t)), "")


def detokenise(pieces: Column) -> Column:
    """Word pieces as text: no tags, ``▁`` is a blank."""
    return F.trim(F.replace(F.array_join(F.filter(pieces, lambda p: ~F.startswith(p, F.lit("<|"))), ""), F.lit("▁"), F.lit(" ")))


def render(text: Column) -> Column:
    """Every tag by its emoji, in order."""
    for tag, sign in RENDERED:
        text = F.replace(text, F.lit(tag), F.lit(sign))
    return text


def count_tags(text: Column) -> Column:
    """A struct: the text without tags, and the occurrences of each tag of ``RENDERED``, counted after the earlier ones are gone."""
    tags = F.array(*[F.lit(tag) for tag, _ in RENDERED])
    start = F.struct(text.alias("text"), F.expr("cast(array() as array<int>)").alias("counts"))

    def step(done: Column, tag: Column) -> Column:
        rest = F.replace(done["text"], tag, F.lit(""))
        many = ((F.length(done["text"]) - F.length(rest)) / F.length(tag)).cast("int")
        return F.struct(rest.alias("text"), F.concat(done["counts"], F.array(many)).alias("counts"))

    return F.aggregate(tags, start, step)


def tag_counts(counted: Column) -> dict[str, Column]:
    """Occurrences by tag, from ``count_tags``."""
    return {tag: F.get(counted["counts"], k) for k, (tag, _) in enumerate(RENDERED)}


def dominant_emotion(counts: dict[str, Column]) -> Column:
    """The emotion that occurs most; NEUTRAL, then the earlier, wins ties."""
    best, most = F.lit("<|NEUTRAL|>"), counts["<|NEUTRAL|>"]
    for tag, _ in EMOTIONS:
        more = counts[tag] > most
        best, most = F.when(more, F.lit(tag)).otherwise(best), F.greatest(counts[tag], most)
    return best


def tighten(text: Column) -> Column:
    """No blank beside an emoji: one before and one after each is taken, sign by sign."""
    signs = F.array(*[F.lit(sign) for sign in EMOTION_SIGNS + EVENT_SIGNS])
    return F.trim(F.aggregate(signs, text, lambda done, sign: F.replace(F.replace(done, F.concat(F.lit(" "), sign), sign), F.concat(sign, F.lit(" ")), sign)))


def render_rich(text: Column) -> Column:
    """Text without tags, events' emoji in front (the last table entry first), the dominant emotion's at the end."""

    def build(counted: Column) -> Column:
        counts = tag_counts(counted)
        front = [F.when(counts[tag] > 0, F.lit(sign)).otherwise(F.lit("")) for tag, sign in reversed(EVENTS) if sign]
        end = lambda emotion: F.coalesce(*[F.when(emotion == tag, F.lit(sign)) for tag, sign in EMOTIONS])
        return F.concat(*front, counted["text"], let(dominant_emotion(counts), end))

    return tighten(let(count_tags(text), build))


def split_languages(text: Column) -> Column:
    """The parts between language tags."""
    text = F.replace(text, F.lit("<|nospeech|><|Event_UNK|>"), F.lit("❓"))
    for tag in LANGUAGES:
        text = F.replace(text, F.lit(tag), F.lit("<|lang|>"))
    return F.split(text, r"<\|lang\|>")


def merge_rendered(parts: Column) -> Column:
    """Rendered parts on end; an emoji that repeats at a seam (the event in front, the emotion behind) is shown once."""
    event = lambda s: F.when((F.length(s) > 0) & F.lit(EVENT_SIGNS).contains(F.substring(s, 1, 1)), F.substring(s, 1, 1))
    emotion = lambda s: F.when((F.length(s) > 0) & F.lit(EMOTION_SIGNS).contains(F.substring(s, -1, 1)), F.substring(s, -1, 1))
    start = F.struct(F.concat(F.lit(" "), F.element_at(parts, 1)).alias("text"), F.lit(None).cast("string").alias("event"))

    def step(done: Column, part: Column) -> Column:
        cut = F.when(event(part) == done["event"], F.substring(part, 2, 1_000_000_000)).otherwise(part)
        kept = F.when(emotion(cut) == emotion(done["text"]), F.substring(done["text"], F.lit(1), F.length(done["text"]) - 1)).otherwise(done["text"])
        return F.when(part == "", done).otherwise(F.struct(F.concat(kept, F.trim(cut)).alias("text"), event(cut).alias("event")))

    merged = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["text"]
    return F.trim(F.replace(merged, F.lit("The."), F.lit(" ")))


def display_width(text: Column) -> Column:
    """Terminal cells: two for wide characters."""
    return F.length(text) + F.regexp_count(text, F.lit(wide()))


def clip_tail(text: Column, cells: int) -> Column:
    """The end of a text that fits into so many terminal cells; an ellipsis stands for what is cut off in front.

    Whole characters stay, so a clipped text may be a cell narrower than allowed; with one cell or none there is no
    room for more than the ellipsis.
    """
    width = lambda c: F.when(c.rlike(wide()), F.lit(2)).otherwise(F.lit(1))
    start = F.struct(F.lit("").alias("kept"), F.lit(max(0, cells - 1)).alias("room"))

    def step(done: Column, c: Column) -> Column:
        # once a character doesn't fit, nothing before it does
        fits = width(c) <= done["room"]
        return F.struct(F.when(fits, F.concat(c, done["kept"])).otherwise(done["kept"]).alias("kept"), F.when(fits, done["room"] - width(c)).otherwise(F.lit(-1)).alias("room"))

    cut = F.aggregate(F.reverse(F.regexp_extract_all(text, F.lit("(?s)."), 0)), start, step, lambda done: F.concat(F.lit("…"), done["kept"]))
    return F.when(display_width(text) <= cells, text).otherwise(cut if cells > 0 else F.lit(""))


def command_of(message: Column) -> Column:
    """A bare command word, lower-cased; messages that begin with ``{`` are as they came, for ``json_command``."""
    return F.when(F.trim(message).startswith("{"), message).otherwise(F.lower(F.trim(message)))


def format_of(url: Column) -> Column:
    """The ``format`` parameter of a request's address, percent-decoded: float32 or int16, float32 if anything else."""
    asked = F.lower(F.try_url_decode(F.regexp_extract(url, r"[?&]format=([^&#]+)", 1)))
    return F.when(asked.isin("int16", "float32"), asked).otherwise("float32")
