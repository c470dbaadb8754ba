"""The ten operators of this subpackage as queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.decontam import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.warc import archive_round_trip

    read = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


# the digest's 160 bits as four numbers of 40, each eight letters of five
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC) AS place, count(*) OVER (PARTITION BY html) AS n, max(page_id) OVER (PARTITION BY html) AS most FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND most IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND most IS NOT NULL AND place > 1 THEN most END AS refers_to
FROM k
"""


#: (host, path, verdict)
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op3_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.urlgraph import filter_urls

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def _op3_sql() -> str:
    """The rules as one CASE, and the rounds of both rank vectors as one CTE each."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = lambda x: f"CASE WHEN strpos({x}, '://') > 0 THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
    part = lambda x: f"split_part(split_part(split_part({rest(x)}, '/', 1), '?', 1), '#', 1)"
    host = lambda x: f"translate({part(x)}, '{upper}', '{lower}')"
    path = lambda x: f"split_part(split_part(substr({rest(x)}, length({part(x)}) + 1), '?', 1), '#', 1)"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in order)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    steps = [
        f"""u AS (SELECT page_id, coalesce({host("url")}, '') AS host,
            coalesce({path("url")}, '') AS path FROM pages)""",
        f"j AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM u)",
        f"""k AS (SELECT {host("url")} AS src, unnest(regexp_extract_all(html,
            '(?i)href\\s*=\\s*["'']?((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"''\\s>]*)', 1)) AS link FROM pages)""",
        f"l AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM k)",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)",
        "h AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM j GROUP BY 1)",
    ]
    for v, column, src, dst in (("t", "a", "src", "dst"), ("d", "b", "dst", "src")):
        steps += [
            f"{v}h AS (SELECT host, {column} / n AS w FROM h WHERE {column} > 0 AND 2 * {column} > n)",
            f"{v}w AS (SELECT host, w / (SELECT sum(w) FROM {v}h) AS w FROM {v}h)",
            f"{v}s AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS s FROM e)",
            f"{v}0 AS (SELECT host, w AS r FROM {v}w)",
        ]
        for i in range(1, 13):
            steps.append(
                f"{v}{i} AS (SELECT host, sum(r) AS r FROM (SELECT dst AS host, 0.85 * r * s AS r FROM {v}{i - 1} JOIN {v}s ON host = src UNION ALL SELECT host, 0.15 * w FROM {v}w) GROUP BY 1)"
            )
    return f"""WITH {", ".join(steps)}
    SELECT page_id, j.host, path, rule,
      coalesce(said, CASE WHEN coalesce(d12.r, 0) * (SELECT coalesce(sum(w), 1) FROM dh) >= 1e-4 AND coalesce(d12.r, 0) > coalesce(t12.r, 0) THEN 'block' ELSE 'allow' END) AS verdict,
      round(coalesce(t12.r, 0.0), 12) AS trust, round(coalesce(d12.r, 0.0), 12) AS distrust
    FROM j LEFT JOIN t12 ON t12.host = j.host LEFT JOIN d12 ON d12.host = j.host"""


def op4_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foldspark.llm.editcount import edited_counts

    return edited_counts(_documents(spark, sf_dir), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.quality import classify, train

    docs = _documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_spfhp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foldspark.llm.packing import pack

    return pack(_documents(spark, sf_dir), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op8_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.rules import quality_rules

    return quality_rules(_documents(spark, sf_dir))


def op9_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.langid import identify, train

    docs = _documents(spark, sf_dir)
    return identify(docs, train(docs))


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.llm.chat import render

    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS l FROM t GROUP BY 1),
u AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, l FROM c GROUP BY l),
p AS (SELECT DISTINCT l[:k] AS l FROM (SELECT l, unnest(range(1, n_turns)) AS k FROM u)),
m AS (SELECT * FROM u WHERE l NOT IN (SELECT l FROM p))
SELECT t.conv_id, (place - 1) // 256 AS part, any_value(m.n_turns) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY 1, 2
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_normaliser": OP2_SQL, "op3_link_graph_urls": _op3_sql(), "op4_minhash_groups": OP4_SQL, "op10_snapshot_collapse": OP10_SQL}
