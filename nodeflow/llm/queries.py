"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeflow.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_decontamination")
def _decontamination(spark, sf):
    from nodeflow.llm.decontaminate import matches

    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id", "start", "similarity")


@query("op2_line_dedup", """
WITH l AS (SELECT row_number() OVER () AS k, doc_id, source, text FROM documents),
lines AS (SELECT k, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM l),
common AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
kept AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE c.line IS NOT NULL) AS n_removed,
           coalesce(string_agg(s.line, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL), '') AS text
         FROM lines s LEFT JOIN common c ON s.line = c.line GROUP BY k)
SELECT l.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN l.text IS NOT NULL THEN kept.text END AS text
FROM l LEFT JOIN kept USING (k)""")
def _line_dedup(spark, sf):
    from nodeflow.llm.linededup import drop_boilerplate

    return drop_boilerplate(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op5_simhash_near_dedup")
def _simhash(spark, sf):
    from nodeflow.llm.simhash import as_hex, near_duplicates

    return near_duplicates(table(spark, sf, "documents")).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_token_counts")
def _token_counts(spark, sf):
    from nodeflow.llm.tokencounts import token_counts
    import public_tokenizers

    counted = token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_packing")
def _packing(spark, sf):
    from nodeflow.llm.packing import pack

    return pack(table(spark, sf, "documents")).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot")


@query("op10_language_id")
def _language_id(spark, sf):
    from nodeflow.llm.langid import fit, held_out, predict

    docs = table(spark, sf, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("pipeline")
def _pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


@query("op9_token_binary")
def _token_binary(spark, sf):
    from nodeflow.llm.huffman import read_documents, write_ids
    from nodeflow.session import scratch_path
    import public_tokenizers

    target = scratch_path(spark, "token-table")
    write_ids(table(spark, sf, "documents"), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    # ids come back as little-endian 32-bit integers, of which Spark's crc32 is taken
    return read_documents(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_exact_topk")
def _exact_topk(spark, sf):
    from nodeflow.llm.topk import top_products

    return top_products(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query("op4_substring_dedup")
def _substring_dedup(spark, sf):
    from nodeflow.llm.anchors import drop_repeats

    return drop_repeats(table(spark, sf, "documents"))


@query("op3_suffix_array_dedup")
def _suffix_array_dedup(spark, sf):
    from nodeflow.llm.suffixes import drop_repeats

    return drop_repeats(table(spark, sf, "documents"))


def _strength_sql(children: str) -> str:
    """Pseudo-labels of a level's prior, from its children (n, k, m)."""
    return f"""(SELECT 1 / least(0.5, greatest(1e-3, CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1e-3
      ELSE sum(power(k - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END)) - 1 FROM {children} WHERE n > 1)"""


_URL = "regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', {})"


@query("op13_url_filters", f"""
WITH u AS (SELECT page_id, translate({_URL.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_URL.format(2)} AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'g') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k
      FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host),
d AS (SELECT host, n, k, CASE WHEN ip THEN name ELSE array_to_string(p[greatest(1, len(p) - 1):], '.') END AS domain, CASE WHEN ip THEN 'ip' ELSE p[-1] END AS suffix
      FROM (SELECT *, string_split(name, '.') AS p, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$|^\\[') AS ip FROM h)),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM d) AS m FROM d GROUP BY suffix),
s1 AS (SELECT suffix, (q * m + k) / (q + n) AS mean FROM s0, {_strength_sql("s0")} AS x(q)),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS m FROM d JOIN s1 USING (suffix) GROUP BY domain),
d1 AS (SELECT domain, (q * m + k) / (q + n) AS mean FROM d0, {_strength_sql("d0")} AS x(q)),
h0 AS (SELECT host, n, k, mean AS m FROM d JOIN d1 USING (domain)),
ab AS (SELECT host, q * m + k AS a, q * (1 - m) + n - k AS b FROM h0, {_strength_sql("h0")} AS x(q)),
e AS (SELECT *, 1.6448536269514715 AS z, power(a / (a + b), a) / a AS t, power(b / (a + b), b) / b AS v FROM ab),
e2 AS (SELECT *, CASE WHEN a >= 1 AND b >= 1 THEN 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) END AS hh, (z * z - 3) / 6 AS lam FROM e),
bound AS (SELECT host, CASE WHEN a < 1 OR b < 1 THEN CASE WHEN 0.05 < t / (t + v) THEN power(a * (t + v) * 0.05, 1 / a) ELSE 1 - power(b * (t + v) * 0.95, 1 / b) END
            ELSE a / (a + b * exp(2 * (z * sqrt(hh + lam) / hh - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (lam + 5.0 / 6 - 2 / (3 * hh))))) END AS low FROM e2),
r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT u.host, u.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
        FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY u.host, u.path)
SELECT page_id, u.host, u.path, rule, coalesce(action, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN bound ON u.host = bound.host LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path""")
def _url_filters(spark, sf):
    from nodeflow.llm.urlfilter import Rule, judge

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf, "pages"), outcomes, rules)


@query("op12_merkle_manifest")
def _merkle(spark, sf):
    from nodeflow.llm import merkle
    from nodeflow.session import scratch_path

    docs = table(spark, sf, "documents")
    fields = [merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(*fields))
    proofs = merkle.manifest(docs, scratch_path(spark, "manifest"), carry={"tampered": tampered})
    claimed = F.coalesce("tampered", "leaf")
    judged = proofs.select("*", merkle.proof_digest(F.col("steps")).alias("proof"), merkle.folded_root(claimed, F.col("steps")).alias("folded"))
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return judged.select("doc_id", *[F.lower(F.hex(c)).alias(n) for c, n in names.items()], (F.col("folded") == F.col("root")).alias("verified"))


# DuckDB has no crc32: its table by recursion, then one step per digit
_CRC = """RECURSIVE bits(i, step, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc(t) AS (SELECT list(v ORDER BY i) FROM bits WHERE step = 8)"""


def _crc32_sql(number: str) -> str:
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])))"


@query("op11_conversation_trie", f"""
WITH {_CRC},
c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), said := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, ({_crc32_sql("conv_id")} % 9)::BIGINT AS h FROM c, crc),
p AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS path FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
steps AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM p),
nodes AS (SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(steps.path) = depth), '') AS ends,
            coalesce(strlen(any_value(steps.path)[depth].said), 0) AS bytes FROM steps GROUP BY path[1:depth], depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
spread AS (SELECT unnest(range(depth + 1)) AS d, path, n_children, (n_convs - 1) * bytes AS saved FROM full_nodes),
below AS (SELECT path[1:d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY 1)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN below b ON f.path = b.path LEFT JOIN nodes up ON f.depth > 0 AND up.path = f.path[1:f.depth - 1]""")
def _conversation_trie(spark, sf):
    from nodeflow.llm import trie

    convs = trie.conversations(table(spark, sf, "conversations"))
    base, shared = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9
    return trie.prefix_trie(trie.rebased(convs, base, shared, shared_max=8))
