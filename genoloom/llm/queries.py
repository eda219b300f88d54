"""The operators applied to the given tables, one query each."""

from __future__ import annotations

import secrets
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import blobs, decontam, jaccard, langid, merkle, mtree, pii, runs, spans, toxicity, urls, warc
from genoloom.llm.common import remainder, table
from genoloom.session import shared_folder

# The same results in SQL.
OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
q AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM r"""

OP7 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.low, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) r USING (doc_id)"""

_ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
           r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?""")
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(place, kind, pattern, least) AS (VALUES
    (0, 'assign', '{_ASSIGN}[A-Za-z0-9+/_.=-]+', 6), (1, 'access', 'AKIA[A-Z0-9]+', 20),
    (2, 'hex', '[0-9a-f]+', 24), (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 26)),
p AS (
    SELECT doc_id, 0 AS place, regexp_extract_all(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS m,
           string_split_regex(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS g,
           regexp_extract_all(t, '{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1) AS v FROM d
    UNION ALL SELECT doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+'),
           regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9a-f]{{24,}}'), string_split_regex(t, '[0-9a-f]{{24,}}'),
           regexp_extract_all(t, '[0-9a-f]{{24,}}') FROM d
    UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
           string_split_regex(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM d),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p),
s AS (
    SELECT doc_id, i.place, kind, least, length(v[k]) AS size, length(m[k]) AS whole,
           list_sum([length(x) for x in g[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS start
    FROM i JOIN rules USING (place)),
f AS (SELECT doc_id, place, kind, CAST(start AS BIGINT) AS start, CAST(start + whole AS BIGINT) AS stop FROM s WHERE size >= least),
a AS (
    SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3), '') AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
    FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

# The CRC-32 of a number's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _sized(*columns: str) -> str:
    """Values as one text, each with its byte count."""
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', CAST({0} AS VARCHAR)) END"
    return f"sha256(concat({', '.join(one.format(c) for c in columns)}))"


OP12 = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents),
l AS (SELECT doc_id, source, {_sized("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    {_sized("doc_id", "source", "lang", "n_chars", "tampered")} AS claim FROM d),
p AS (SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos FROM l),
node(tree, level, pos, n, h) AS (
    SELECT tree, 0, pos, n, leaf FROM p UNION ALL
    SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 3, n),
sub AS (SELECT tree, h FROM node WHERE n = 1),
top(level, pos, n, h) AS (
    SELECT 0, tree, count(*) OVER (), h FROM sub UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
every AS (SELECT tree, level, pos, n, h FROM node UNION ALL SELECT -1, level, pos, n, h FROM top),
sib AS (
    SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM every a LEFT JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos
    WHERE a.n > 1 GROUP BY 1, 2, 3),
up(k, tree, level, pos, n, h, proof) AS (
    SELECT k, tree, 0, pos, n, claim, '' FROM p UNION ALL
    SELECT k, u.tree, u.level + 1, u.pos // 3, (n + 2) // 3, sha256(concat(l, h, r)), concat(proof, l, r)
    FROM up u JOIN sib s ON s.tree = u.tree AND s.level = u.level AND s.pos = u.pos WHERE n > 1),
out(k, level, pos, n, h, proof) AS (
    SELECT k, 0, u.tree, t.n, u.h, u.proof FROM up u JOIN top t ON t.level = 0 AND t.pos = u.tree WHERE u.n = 1 UNION ALL
    SELECT k, u.level + 1, u.pos // 3, (n + 2) // 3, sha256(concat(l, h, r)), concat(proof, l, r)
    FROM out u JOIN sib s ON s.tree = -1 AND s.level = u.level AND s.pos = u.pos WHERE n > 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, top.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = top.h AS verified
FROM p JOIN sub USING (tree) JOIN out o ON o.k = p.k AND o.n = 1 JOIN top ON top.n = 1"""

OP13 = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
r AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r
    FROM (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text
    FROM each LEFT JOIN (SELECT doc_id AS g, j AS gj FROM gone) ON doc_id = g AND j = gj WHERE gj IS NULL GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def piece_model() -> str:
    """The vocabulary file of the public tokenizers that op2 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_drawn_keys: dict[str, bytes] = {}


def pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: a secret of the deployment, set as genoloom.pii.key.

    Without one a local session takes an open key, with a warning.  On a cluster the open key is
    never taken: a random one is drawn for the application, kept by the driver alone and
    given again on each call, so that its pseudonyms agree but end with it.
    """
    key = spark.conf.get("genoloom.pii.key", None)
    if key is not None:
        return key.encode()
    if spark.sparkContext.master.startswith("local"):
        warnings.warn("genoloom.pii.key is not set: anyone can undo these pseudonyms", stacklevel=2)
        return b"an open key, for tests and examples"
    warnings.warn("genoloom.pii.key is not set: after this application nobody can undo these pseudonyms or make the same again", stacklevel=2)
    return _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op1_pii_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, d, "documents").select("doc_id", "text"), pii_key(spark))
    return found.select("doc_id", "text", "spans", F.size("spans").alias("n_values"))


def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    from genoloom.llm import pieces

    coded = pieces.encode_documents(table(spark, d, "documents").select("doc_id", "text"), piece_model())
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out).select(F.col("doc_id").alias("id"), "lang", "text"))
    return langid.predicted(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


# The rules of the URL filter; every page one of them covers is a labelled URL for the trees.
URL_RULES = urls.parse_rules(allow=["org/", "com/fr/"], block=["example.org/es/", "example.org/en/1", "com/de/"])


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    parts = urls.with_parts(pages)
    _, verdict = urls.rule_of(URL_RULES, F.col("host"), F.col("path"))
    labelled = parts.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label"))
    return urls.judged(pages, URL_RULES, urls.train(labelled)).select(
        "page_id", "host", "path", "rule", "verdict", "block_score")


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit_on_labels(docs.where(~held_out), table(spark, d, "labels").where(~held_out))
    return toxicity.scored(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "score", "predicted")


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    files = warc.write(table(spark, d, "pages"), folder)
    return warc.read(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, d, "documents"), jaccard.Rule(words=3, part=90))


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    ledger = blobs.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    found = blobs.scan(table(spark, d, "documents"), ledger)
    base = F.filter("spans", lambda x: x["place"] < len(blobs.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[count(r.kind) for r in blobs.BASE],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_top_k(spark: SparkSession, d: str) -> DataFrame:
    return mtree.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of ids whose crc32 ends in 0 with their words from place a on replaced by
    repeats of the p words there; the other texts as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.expr("g"), F.expr("n")
    a, p = F.expr("g % n"), F.expr("1 + (n - g % n) div (3 + g % 8)")

    def original(w: Column, i: Column) -> Column:
        return F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % p).cast("int")))

    return docs.withColumn("w", F.when(h % 10 == 0, words)).withColumns(
        {"n": F.size("w").cast("long"), "g": F.floor(h / 10)}).withColumn(
        "text", F.when(n > 0, F.array_join(F.transform("w", original), " ")).otherwise(F.col("text"))).select("doc_id", "text")


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = runs.periodic_runs(_with_planted_runs(table(spark, d, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    tampered = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proofs = merkle.manifest(table(spark, d, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], claimed={"text": tampered})
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = spans.deduplicated(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_pseudonyms, op2_sentencepiece, op3_language_id, op4_url_filter, op5_toxicity, op6_warc, op7_jaccard_join, op8_decontamination, op9_secret_scan, op10_top_k, op11_periodic_runs, op12_merkle_manifest, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6, "op7_jaccard_join": OP7, "op9_secret_scan": OP9, "op10_top_k": OP10, "op12_merkle_manifest": OP12, "op13_substring_dedup": OP13}
