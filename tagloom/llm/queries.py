"""The queries opN_<name> of this subpackage, their SQL, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, embed_dedup, fingerprint, langid, mixing, near_dedup, packing, quality, sharding, suffix_dedup, token_store, toxicity, whitening
from .common import read
from .tokenization import public

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE_SIZE = 65537


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(read(spark, sf_dir, "documents"), near_dedup.Setting(words=4))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_against_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.scan(token_store.write(read(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), end_id=0))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public("word_bpe_49k.json"), end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "source", "slot", "shard")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_store": op3_token_store,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}


def _op10_sql() -> str:
    owner = ",".join(SHARDS[i].removeprefix("shard-") for i in sharding.lookup_table(SHARDS, TABLE_SIZE))
    return f"""
WITH owners AS (SELECT string_split('{owner}', ',') AS o),
placed AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.DIGITS}))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-' || o[slot + 1] AS shard FROM placed, owners
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Components by walking links from every row; fine for the group sizes of the small tables.
_WALK = "reach AS (SELECT a AS id, b AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a), low AS (SELECT id, min(other) AS m FROM reach GROUP BY 1)"

_OP1 = rf"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM split),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_WALK}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.id = d.doc_id
"""

_OP9 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_WALK}
SELECT d.vec_id, (SELECT count(*) FROM both_ WHERE a = d.vec_id) AS n_links, least(d.vec_id, coalesce(m, d.vec_id)) AS component_id, d.vec_id <= coalesce(m, d.vec_id) AS kept FROM embeddings d LEFT JOIN low ON low.id = d.vec_id
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5(concat_ws(':', 17, doc_id)), 1, 15))::BIGINT AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1])[place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM p),
o AS (SELECT weight, most, coalesce(sum(most) OVER x, 0) AS full_before, coalesce(sum(weight) OVER x, 0) AS weight_before FROM w WHERE source_size > 0 WINDOW x AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT weight, most, ((SELECT 1.5::DOUBLE * sum(source_size) FROM w) - full_before) / ((SELECT sum(weight) FROM o) - weight_before) AS unit FROM o),
u AS (SELECT max(unit) FILTER (unit * weight < most) AS unit FROM v),
t AS (SELECT w.*, CASE WHEN source_size = 0 THEN 0 WHEN unit IS NULL THEN most ELSE least(most, weight * unit) END AS target FROM w, u),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, CASE WHEN whole < 2 THEN round(target)::BIGINT - whole * source_size ELSE 0 END AS rest FROM q)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY place ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

#: Every window of 200 bytes, as hexadecimal digits, by its md5 digest; texts are cut into stretches first, since finding a place in a long text takes time.
_OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, k, substr(h, 2 * k + 1, 1400) AS part, length(h) // 2 AS n FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 500)) AS k FROM d)),
w AS (SELECT r, k + i AS i, md5_number(substr(part, 2 * i + 1, 400)) AS x FROM (SELECT r, k, n, part, unnest(range(0, least(500, n - 199 - k))) AS i FROM c)),
twice AS (SELECT x FROM w GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 AS new FROM w SEMI JOIN twice USING (x)),
g AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM f),
s AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (r) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

#: crc32 of the text k, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda j: ((ascii(substr(k, i, 1))::BIGINT >> j) & 1))))), lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"
#: Ways are texts: nine digits of cost, then the audit (J and S: the assistant's I and R).
_OP13 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
c AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault,
  left(role, 1) AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
w AS (
  SELECT conv_id, 0::BIGINT AS place, '000000000' AS n, NULL::VARCHAR AS s, '000000005I' AS u, '000000010IJ' AS a FROM g
  UNION ALL
  SELECT conv_id, place, n, s, u, least(a, lpad((left(u, 9)::BIGINT + 5)::VARCHAR, 9, '0') || substr(u, 10) || 'J')
  FROM (SELECT conv_id, place, n, s, least(u, lpad((left(least(n, s, a), 9)::BIGINT + 5)::VARCHAR, 9, '0') || substr(least(n, s, a), 10) || 'I') AS u, a
    FROM (SELECT conv_id, place, dn AS n, least(ds, CASE WHEN i = 's' THEN kn END) AS s, least(du, CASE WHEN i = 'u' THEN kx END, rx) AS u, least(da, CASE WHEN i = 'a' THEN ku END, ru) AS a
      FROM (SELECT w.conv_id, f.place, i, {{steps}}
        FROM (SELECT *, least(n, s, a) AS x FROM w) w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = w.place + 1)))),
e AS (SELECT g.*, least(w.n, w.a) AS best FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.place = g.n),
p AS (SELECT conv_id, unnest(regexp_extract_all(substr(best, 10), '[IJ]*[DKRS]')) AS edit, generate_subscripts(regexp_extract_all(substr(best, 10), '[IJ]*[DKRS]'), 1) AS place FROM e),
l AS (SELECT f.conv_id, string_agg(replace(replace(left(edit, length(edit) - 1), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) || CASE right(edit, 1) WHEN 'D' THEN '' WHEN 'R' THEN 'user:' || text || chr(10) WHEN 'S' THEN 'assistant:' || text || chr(10) ELSE role || ':' || text || chr(10) END, '' ORDER BY f.place) AS lines FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place GROUP BY 1),
t AS (SELECT e.*, coalesce(lines, '') || replace(replace(regexp_extract(substr(best, 10), '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) AS lines FROM e LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM e.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(translate(substr(best, 10), 'JS', 'IR'), '') AS audit, sha256(CASE WHEN coalesce(lines, '') = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM ids LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def _op13_sql() -> str:
    def step(name: str, way: str, cost: str, letter: str, when: str = "TRUE") -> str:
        return f"CASE WHEN {when} THEN lpad((left({way}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{letter}' END AS {name}"

    stays, more = "fault NOT IN (1, 2)", "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    gone = [step(f"d{s}", f"w.{s}", "2", "D") for s in "nsua"]
    kept = [step(f"k{s}", f"w.{s}", more, "K", stays) for s in "nxu"]
    return _OP13.format(steps=", ".join([*gone, *kept, step("rx", "w.x", f"1 + {more}", "R", stays), step("ru", "w.u", f"1 + {more}", "S", stays)]))


SQL = {
    "op1_near_dedup": _OP1,
    "op4_mix": _OP4,
    "op9_embedding_dedup": _OP9,
    "op10_sharding": _op10_sql(),
    "op12_suffix_dedup": _OP12,
    "op13_conversation_repair": _op13_sql(),
}
