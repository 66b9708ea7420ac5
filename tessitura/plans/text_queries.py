"""Transcript queries. Documents and conversations stand in for transcripts; tags are put in from their own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import lookups
from tessitura.functions import text as T
from tessitura.functions.audio import json_command
from tessitura.operators import scoring

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A stand-in hypothesis: every third text as it is, one with e for a, one without its first two characters.
_HYP = "case {k} % 3 when 0 then replace(text, 'e', 'a') when 1 then substr(text, 3) else text end"
#: DuckDB measures bytes, so each capital letter beyond ASCII becomes one small letter, which upper case has none of.
_SQL_NORM = "translate(replace(upper(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 'ẞ', 'SS'), 'ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ', 'abcdefghijklmnopqrstu')"
_PAIRS = f"""select conv_id, turn, role, {_SQL_NORM.format(x="coalesce(text, '')")} as r, {_SQL_NORM.format(x=_HYP.format(k="(conv_id + turn)"))} as h from conversations where text is not null"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    refs = c.select("conv_id", "turn", "role", F.col("text").alias("ref"))
    hyps = c.select("conv_id", "turn", F.expr(_HYP.format(k="(conv_id + turn)")).alias("hyp"))
    return scoring.score_pairs(refs, hyps, ["conv_id", "turn"])


@query(
    f"""select role, count(*) as n_files, cast(sum(levenshtein(r, h)) as bigint) as edits, cast(sum(length(r)) as bigint) as ref_chars,
round(100.0 * sum(levenshtein(r, h)) / greatest(sum(length(r)), 1), 6) as micro_cer from ({_PAIRS}) group by role"""
)
def micro_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.micro_rate(_scored(spark, sf_dir), "role")


@query(
    """with t as (select conv_id, turn, length(text) / 16.0 as duration, case when (conv_id + turn) % 4 <> 0 then length(text) / 320.0 end as seconds, role from conversations where text is not null)
select role, count(seconds) as n_timed, round(sum(seconds) / sum(case when seconds is not null then duration end), 6) as rtf,
round(sum(case when seconds is not null then duration end) / sum(seconds), 6) as speed_up from t group by role"""
)
def real_time_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    scored = c.select("conv_id", "turn", "role", (F.length("text") / 16.0).alias("duration"))
    times = c.where("(conv_id + turn) % 4 <> 0").select("conv_id", "turn", (F.length("text") / 320.0).alias("seconds"))
    return scoring.real_time(scored, times, ["conv_id", "turn"], "role")


@query(
    """select conv_id, turn, case when turn % 2 = 0 then printf('%03d', conv_id) else 'k' || conv_id end as key from conversations"""
)
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", scoring.reference_key(F.when(F.col("turn") % 2 == 0, F.col("conv_id")), F.concat(F.lit("k"), F.col("conv_id").cast("string"))).alias("key"))


_TAGGED = "'<|' || lang || '|><|NEUTRAL|>' || text || '<|' || source || '|> <|Speech|>'"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TAGGED).alias("tagged"))


@query(f"select doc_id, regexp_replace({_TAGGED}, '<\\|[^|]*\\|>', '', 'g') as clean_text from documents")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", T.strip_tags(F.col("tagged")).alias("clean_text"))


@query(f"select doc_id, regexp_replace({_TAGGED}, '<\\|.*\\|>', '', 'g') as clean_text from documents")
def strip_tags_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", T.strip_tags_greedy(F.col("tagged")).alias("clean_text"))


@query(f"select doc_id, upper(regexp_replace(regexp_replace({_TAGGED}, '<\\|[^|]*\\|>', '', 'g'), '[^A-Za-z0-9_]', '', 'g')) as norm_text from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", T.normalize(F.col("tagged"), "A-Za-z0-9_").alias("norm_text"))


@query(f"select doc_id, upper(replace(regexp_replace(regexp_replace({_TAGGED}, '<\\|[^|]*\\|>', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 'ß', 'SS')) as norm_text from documents")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default normal form: letters and digits of all scripts. DuckDB leaves a sharp s as it is, which its SQL spells out."""
    return _tagged(spark, sf_dir).select("doc_id", T.normalize(F.col("tagged")).alias("norm_text"))


@query("select doc_id, array_to_string(regexp_extract_all(text, '([\\x21-\\x7F\\x00-\\x08\\x0E-\\x1F]+|[^\\x00-\\x7F])'), '/') as tokens from documents")
def split_code_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.split_mixed(F.col("text")), "/").alias("tokens"))


@query(
    """with t as (select doc_id, regexp_extract_all(text, '([\\x21-\\x7F\\x00-\\x08\\x0E-\\x1F]+|[^\\x00-\\x7F])') as w from documents)
select doc_id, cast(len(list_filter(w, lambda x: regexp_matches(x, '^[a-zA-Z'']+$'))) as int) as n_english,
trim(array_to_string(list_transform(w, lambda x: case when regexp_matches(x, '^[a-zA-Z'']+$') then ' ' || x else x end), ''), ' ') as line from t"""
)
def join_code_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.split_mixed(F.col("text")).alias("w"))
    return words.select("doc_id", F.size(F.filter("w", T.is_english)).alias("n_english"), T.join_mixed(F.col("w")).alias("line"))


@query("select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: case when c = ' ' then '<space>' else c end), '/') as tokens from documents")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.char_tokens(F.col("text")), "/").alias("tokens"))


@query(
    """with p as (select doc_id, list_concat(['<|' || lang || '|>'], list_transform(string_split(text, ' '), lambda w: '▁' || w)) as p from documents)
select doc_id, trim(replace(array_to_string(list_filter(p, lambda x: not starts_with(x, '<|')), ''), '▁', ' '), ' ') as detok from p"""
)
def detokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pieces = F.concat(F.array(F.concat(F.lit("<|"), F.col("lang"), F.lit("|>"))), F.transform(F.split("text", " "), lambda w: F.concat(F.lit("▁"), w)))
    return d.select("doc_id", T.detokenise(pieces).alias("detok"))


# A tagged text whose tags depend on the row: several events, emotions and languages, in changing numbers.
_RICH = (
    "case conv_id % 3 when 0 then '<|en|>' when 1 then '<|zh|>' else '<|nospeech|><|Event_UNK|>' end || repeat('<|HAPPY|>', cast(turn % 3 as int)) || repeat('<|SAD|>', cast(conv_id % 4 as int))"
    " || case when turn % 2 = 0 then '<|BGM|>' else '<|Speech|>' end || text || case when conv_id % 5 = 0 then ' <|Laughter|> <|Cough|>' else '' end || '<|woitn|>'"
    " || case when turn % 4 = 1 then '<|ja|><|ANGRY|><|BGM|>The. 你好，世界 end' else '' end"
)


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.expr(_RICH).alias("rich"))


def _sql_replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_counts(x: str) -> dict[str, str]:
    out = {}
    for tag, _ in T.RENDERED:
        out[tag] = f"cast((length({x}) - length(replace({x}, '{tag}', ''))) / {len(tag)} as int)"
        x = f"replace({x}, '{tag}', '')"
    return out


_COUNTED = ("<|nospeech|><|Event_UNK|>", "<|HAPPY|>", "<|SAD|>", "<|BGM|>", "<|Laughter|>", "<|Cough|>", "<|Event_UNK|>")


@query(f"with r as (select conv_id, turn, {_RICH} as x from conversations where text is not null) select conv_id, turn, " + ", ".join(f"{_sql_counts('x')[t]} as n{k}" for k, t in enumerate(_COUNTED)) + " from r")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.tag_counts(F.col("counted"))
    return _rich(spark, sf_dir).withColumn("counted", T.count_tags(F.col("rich"))).select("conv_id", "turn", *[counts[t].alias(f"n{k}") for k, t in enumerate(_COUNTED)])


@query(f"with r as (select conv_id, turn, {_RICH} as x from conversations where text is not null) select conv_id, turn, {_sql_replaced('x', T.RENDERED)} as rendered from r")
def emoji_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rich(spark, sf_dir).select("conv_id", "turn", T.render(F.col("rich")).alias("rendered"))


def _sql_rich(x: str) -> str:
    """Rendering in steps, each a list entry of one element, so that no step is repeated in the text of the next."""
    counts = _sql_counts("x")
    steps = [f"select *, {', '.join(f'{c} as c{k}' for k, c in enumerate(counts.values()))}, {_sql_replaced('x', [(t, '') for t, _ in T.RENDERED])} as b from ({x})"]
    at = {t: f"c{k}" for k, t in enumerate(counts)}
    front = " || ".join(f"case when {at[t]} > 0 then '{s}' else '' end" for t, s in reversed(T.EVENTS))
    most = "greatest(" + ", ".join(at[t] for t, _ in T.EMOTIONS) + ")"
    end = f"case when {at['<|NEUTRAL|>']} = {most} then '' " + " ".join(f"when {at[t]} = {most} then '{s}'" for t, s in T.EMOTIONS) + " end"
    steps.append(f"select *, {front} || b || {end} as y from ({steps[-1]})")
    tight = "y"
    for s in T.EMOTION_SIGNS + T.EVENT_SIGNS:
        tight = f"replace(replace({tight}, ' {s}', '{s}'), '{s} ', '{s}')"
    return f"select * exclude (y), trim({tight}, ' ') as rendered from ({steps[-1]})"


@query(f"select conv_id, turn, rendered from ({_sql_rich(f'select conv_id, turn, {_RICH} as x from conversations where text is not null')})")
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rich(spark, sf_dir).select("conv_id", "turn", T.render_rich(F.col("rich")).alias("rendered"))


def _sql_merged() -> str:
    """Parts between language tags as rows, rendered, then folded in order."""
    split = _sql_replaced("replace(x, '<|nospeech|><|Event_UNK|>', '❓')", [(t, "<|lang|>") for t in T.LANGUAGES])
    parts = f"select conv_id, turn, unnest(p) as x, generate_subscripts(p, 1) as i from (select conv_id, turn, string_split({split}, '<|lang|>') as p from (select conv_id, turn, {_RICH} as x from conversations where text is not null))"
    event = lambda s: f"case when length({s}) > 0 and contains('{T.EVENT_SIGNS}', left({s}, 1)) then left({s}, 1) end"
    emotion = lambda s: f"case when length({s}) > 0 and contains('{T.EMOTION_SIGNS}', right({s}, 1)) then right({s}, 1) end"
    cut = f"case when ({event('b.t')}) = a.e then substr(b.t, 2) else b.t end"
    kept = f"case when ({emotion(f'({cut})')}) = ({emotion('a.t')}) then substr(a.t, 1, length(a.t) - 1) else a.t end"
    fold = f"list_reduce(l, lambda a, b: case when b.t = '' then a else struct_pack(t := ({kept}) || trim({cut}, ' '), e := {event(f'({cut})')}) end)"
    listed = f"select conv_id, turn, list(struct_pack(t := case when i = 1 then ' ' || rendered else rendered end, e := cast(null as varchar)) order by i) as l from ({_sql_rich(parts)}) group by conv_id, turn"
    return f"select conv_id, turn, trim(replace(({fold}).t, 'The.', ' '), ' ') as rendered from ({listed})"


@query(_sql_merged())
def rich_text_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts between language tags, each rendered, emoji merged at the seams."""
    return _rich(spark, sf_dir).select("conv_id", "turn", T.merge_rendered(F.transform(T.split_languages(F.col("rich")), T.render_rich)).alias("rendered"))


#: Signs put behind the rendered texts. As facts: the first eight take two cells each, the other five one.
_WIDE_SIGNS, _NARROW_SIGNS = "⌚⏩☔⚡✅🚀語Ａ", "☂✓™ｱ→"
#: As a fact: each of these, which rendering and the query put in, takes two cells; the texts' own letters take one.
_WIDE_RENDERED = "❓😊😔😡🎼👏😀😰🤢😮😭🤧😷你好，世界"


@query(
    f"""select conv_id, turn, cast(length(x) + len(list_filter(string_split(x, ''), lambda c: contains('{_WIDE_RENDERED}{_WIDE_SIGNS}', c))) as int) as cells
from (select conv_id, turn, rendered || substr('{_WIDE_SIGNS}{_NARROW_SIGNS}', 1 + cast((conv_id + turn) % 13 as int), 4) as x from ({_sql_rich(f'select conv_id, turn, {_RICH} as x from conversations where text is not null')}))"""
)
def cell_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rendered texts with some wide and narrow signs behind them; the SQL has the signs' widths as plain facts."""
    signs = F.substr(F.lit(_WIDE_SIGNS + _NARROW_SIGNS), 1 + ((F.col("conv_id") + F.col("turn")) % 13).cast("int"), F.lit(4))
    return _rich(spark, sf_dir).select("conv_id", "turn", T.display_width(F.concat(T.render_rich(F.col("rich")), signs)).alias("cells"))


@query("select event_id, lower(trim(case when event_id % 2 = 0 then '  ' || upper(event_type) || ' ' else event_type end, ' ')) as command from events")
def bare_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.command_of(F.expr("case when event_id % 2 = 0 then '  ' || upper(event_type) || ' ' else event_type end")).alias("command"))


_MESSAGE = "case event_id % 5 when 0 then ' {\"type\": \"' || upper(event_type) || '\", \"n\": 1} ' when 1 then '{\"type\": \"' || event_type || '\"} x' when 2 then '{\"kind\": 3}' when 3 then '[1]' else ' ' || upper(event_type) end"


@query("select event_id, case event_id % 5 when 0 then lower(event_type) when 1 then '' when 2 then '' when 3 then '[1]' else lower(event_type) end as command from events")
def json_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON frames and bare words; what follows an object breaks it."""
    return table(spark, sf_dir, "events").select("event_id", json_command(F.expr(_MESSAGE)).alias("command"))


@query("select doc_id, cast(case doc_id % 3 when 0 then 14 when 1 then 15 else case when doc_id % 2 = 0 then 14 else 15 end end as int) as norm_id from documents")
def text_norm_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit choice, else the flag's."""
    explicit = F.when(F.col("doc_id") % 3 == 0, "withitn").when(F.col("doc_id") % 3 == 1, "woitn")
    return table(spark, sf_dir, "documents").select("doc_id", lookups.choose_text_norm(explicit, F.col("doc_id") % 2 == 0, lookups.TEXT_NORM_IDS).alias("norm_id"))


@query("select event_id, case event_id % 3 when 1 then 'int16' else 'float32' end as format from events")
def handshake_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("case event_id % 3 when 0 then 'ws://host/?x=1' when 1 then '/?a=b&format=INT16' else '/?format=float64' end")
    return table(spark, sf_dir, "events").select("event_id", T.format_of(url).alias("format"))


@query("select doc_id, cast(case lang when 'zh' then 3 when 'en' then 4 when 'yue' then 7 when 'ja' then 11 when 'ko' then 12 when 'nospeech' then 13 else 0 end as int) as lang_id, cast(case when doc_id % 2 = 0 then 14 else 15 end as int) as norm_id from documents")
def query_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lookups.choose_text_norm(F.lit(None).cast("string"), F.col("doc_id") % 2 == 0, lookups.TEXT_NORM_IDS)
    return table(spark, sf_dir, "documents").select("doc_id", lookups.language_id(F.col("lang")).alias("lang_id"), norm.alias("norm_id"))


@query("select d.doc_id, d.lang, d.source, length(d.text) as target_len, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("target_len"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("select page_id, coalesce(case when page_id % 2 = 0 then string_split('a,b,c', ',')[cast(page_id % 4 + 1 as int)] end, url) as key from pages")
def default_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 2 == 0, F.get(F.split(F.lit("a,b,c"), ","), (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", lookups.default_key(given, F.col("url")).alias("key"))
