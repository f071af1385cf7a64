"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversation, hnsw, line_dedup, mixing, quality_qda, quality_rules, simhash, toxicity, url_rules, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy line deduplication of ``documents``: what became of each."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: a row for each time that a document is taken."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lang", "source", "mix_domain", "mix_epoch", "mix_tokens")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def _held_out(parts: int, rest: int):
    return F.coalesce(toxicity.fold("doc_id", parts) == rest, F.lit(False))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _held_out(3, 1)
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _held_out(4, 2)
    scored = quality_qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)(:\d+)?>$", 1).try_cast("long")
    size = F.coalesce(F.octet_length("payload"), F.col("http_length")).cast("long")
    return read.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: (host, path, verdict) of the rules that the URL query judges by.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; URLs that no rule fits are allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every text of ``documents``."""
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), pattern())[0]


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of ``conv_id:turn``; nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    made = rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return made.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return conversation.repair(damaged(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1,
        "op2_mix_sources": op2,
        "op3_nearest_vectors": op3,
        "op4_bpe_codec": op4,
        "op5_simhash": op5,
        "op6_quality_rules": op6,
        "op7_toxicity": op7,
        "op8_quality_classifier": op8,
        "op9_token_counts": op9,
        "op10_warc": op10,
        "op11_url_rules": op11,
        "op12_alignment": op12,
        "op13_conversation_repair": op13,
        "pipeline": pipeline,
    }


def _fill_sql(nodes: str, parent: str, name: str, out: str) -> str:
    """Shares of ``nodes(parent, name, w, cap, budget)``, as CTEs that end in ``out`` with a column own."""
    return f"""
    {out}_a AS (SELECT *, sum(w) OVER p - coalesce(sum(w) OVER b, 0) AS w_left, budget - coalesce(sum(cap) OVER b, 0) AS b_left FROM {nodes}
        WINDOW p AS (PARTITION BY {parent}), b AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {out}_b AS (SELECT *, b_left > 0 AND cap::HUGEINT * w_left <= b_left::HUGEINT * w AS is_full FROM {out}_a),
    {out}_c AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER p AS b_rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p AS w_rest
        FROM {out}_b WINDOW p AS (PARTITION BY {parent})),
    {out} AS (SELECT * EXCLUDE (budget), CASE WHEN is_full THEN cap WHEN w_rest = 0 THEN 0
        ELSE least((greatest(b_rest, 0)::HUGEINT * w) // w_rest, cap) END::BIGINT AS own FROM {out}_c)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _mix_sql(mix: mixing.Mix) -> str:
    # The domain is a checksum that DuckDB has no function for: CRC-32, bit by bit over the bytes of the source.
    crc = """list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(source))) // 2), lambda i: CAST('0x' || substr(hex(encode(source)), 2 * i + 1, 2) AS BIGINT))),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""
    epochs = ", ".join(f"({e})" for e in range(mix.max_epochs))
    return f"""
WITH sources AS (SELECT source, 'd' || (xor({crc}, 4294967295) % 4) AS domain FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)),
docs AS (SELECT doc_id, d.lang AS lang0, d.source AS source0, coalesce(d.lang, '') AS lang, s.source AS source, s.domain AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tok FROM documents d JOIN sources s ON coalesce(d.source, '') = s.source),
leaves AS (SELECT domain, lang, source, sum(tok)::BIGINT AS supply, sum(tok)::BIGINT * {mix.max_epochs} AS cap FROM docs GROUP BY ALL HAVING sum(tok) > 0),
n1 AS (SELECT 0 AS root, domain, {_case("domain", mix.domains)} AS w, sum(cap)::BIGINT AS cap, (SELECT floor(sum(supply) * {mix.budget_percent} / 100)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain),
{_fill_sql("n1", "root", "domain", "f1")},
n2 AS (SELECT l.domain, lang, {_case("lang", mix.languages)} AS w, sum(l.cap)::BIGINT AS cap, any_value(f1.own) AS budget FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, lang),
{_fill_sql("n2", "domain", "lang", "f2")},
n3 AS (SELECT l.domain, l.lang, source, 1 AS w, l.cap, supply, f2.own AS budget FROM leaves l JOIN f2 USING (domain, lang)),
{_fill_sql("n3", "domain, lang", "source", "f3")},
taken AS (SELECT d.*, e.epoch, f3.own // supply AS n_whole, f3.own % supply AS rest,
    coalesce(sum(tok) OVER (PARTITION BY d.domain, d.lang, d.source, e.epoch ORDER BY md5('{mix.seed}-' || e.epoch || '-' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM docs d JOIN f3 USING (domain, lang, source), (VALUES {epochs}) e(epoch))
SELECT doc_id, lang0 AS lang, source0 AS source, domain AS mix_domain, epoch::INTEGER AS mix_epoch, tok::BIGINT AS mix_tokens
FROM taken WHERE epoch < n_whole OR (epoch = n_whole AND before < rest)"""


def _rules_sql() -> str:
    r = quality_rules
    word = r"[^\x20\x09-\x0D]+"
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in r.BOILERPLATE)
    count = lambda text, chars: f"(length({text}) - length(translate({text}, '{chars}', '')))"
    n = f"len(regexp_extract_all(l, '{word}'))"
    marks = f"regexp_matches(l, '[{r.SENTENCE_MARKS}]')"
    fails = f"""(({n} >= {r.PROSE_WORDS} AND NOT {marks})
        OR {count("l", r.SYMBOLS)} * 100 > {n} * {r.MAX_SYMBOL_WORDS_PERCENT} OR {count("l", "!")} * 100 > {n} * {r.MAX_SYMBOL_WORDS_PERCENT}
        OR ({n} >= {r.PROSE_WORDS} AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}')) OR {phrases})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM d),
g AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
s AS (SELECT b.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    {count("text", r.SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(list_sum(list_transform(list_filter(ls, lambda l: NOT {fails}), lambda l: {n})), 0))::BIGINT AS n_lost_words
    FROM b LEFT JOIN rep ON b.r = rep.r),
v AS (SELECT *, n_words < {r.MIN_WORDS} OR n_repeat_words * 100 > n_words * {r.MAX_REPEATED_PERCENT} AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_lost_words * 100 <= n_words * {r.MAX_LOST_PERCENT} AS kept, n_lost_words FROM v"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS place, sha1(html) AS h FROM p
    WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST)),
bits AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(h, i + 1, 1))]), '') AS b FROM f)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN place > 1 THEN first END AS refers_to
FROM bits"""


URL_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
k(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT r, h || p AS rule, v FROM u JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": _mix_sql(mixing.Mix()), "op6_quality_rules": _rules_sql(), "op10_warc": WARC_SQL, "op11_url_rules": URL_SQL}
