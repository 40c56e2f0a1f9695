"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, html, knn, language, pieces, toxicity, urls, warc
from .common import table
from .sharding import shard_by_bytes
from .simhash import near_duplicates


def op1_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op3_pieces(spark, sf_dir):
    found = pieces.encode(table(spark, sf_dir, "documents"), n_best=4)
    scores = F.concat(F.array("score"), F.col("others.score"))
    return found.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), scores.alias("scores"), "others", "exact")


def op4_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).withColumn("score", F.round("score", 6))


def op7_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40)


def op8_knn(spark, sf_dir):
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op10_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3)


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_html": op2_html,
        "op3_pieces": op3_pieces,
        "op4_warc": op4_warc,
        "op5_toxicity": op5_toxicity,
        "op6_language": op6_language,
        "op7_sharding": op7_sharding,
        "op8_knn": op8_knn,
        "op9_urls": op9_urls,
        "op10_simhash": op10_simhash,
    }


_RULES_SQL = {"block": [("net", "/"), ("example.com", "/de/")], "allow": [("example.net", "/en/"), ("org", "/fr/")]}


def _op4_sql() -> str:
    """Base 32 by hand: 32 groups of 5 bits, each cut out of two hexadecimal digits of the SHA-1."""
    digit = lambda at: f"(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
    letters = []
    for k in range(32):
        at, off = 5 * k // 4 + 1, 5 * k % 4
        second = digit(at + 1) if at < 40 else "0"
        letters.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((({digit(at)} * 16 + {second}) // {1 << (3 - off)}) % 32) AS int) + 1, 1)")
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
d AS (SELECT p.page_id, p.url, CAST(strlen(p.html) AS bigint) AS n, sha1(p.html) AS h, g.first FROM p JOIN g ON p.html = g.html)
SELECT page_id, n AS payload_bytes, {" || ".join(letters)} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM d
"""


_OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS k FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS bigint) AS score FROM c q JOIN c ON q.k = c.k AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 20
"""


def _op9_sql() -> str:
    rules = sorted(((v, h, p) for v, x in _RULES_SQL.items() for h, p in x), key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR right(host, {len(h) + 1}) = '.{h}') AND left(path, {len(p)}) = '{p}'"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sql = f"""
WITH a AS (SELECT row_number() OVER () AS row, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  '^^^' || regexp_replace(translate(rest, '{upper}', '{lower}'), '[^a-z0-9./_?=&#%:-]', '~', 'g') || '$' AS text, substr(md5(coalesce(url, '')), 1, 1) < '5' AS aside FROM a),
c AS (SELECT *, {rule} AS rule, {says} AS says FROM b),
o AS (SELECT row, substr(text, CAST(k AS int), 4) AS gram, CASE WHEN says = 'allow' AND NOT aside THEN 1 ELSE 0 END AS allow, CASE WHEN says = 'block' AND NOT aside THEN 1 ELSE 0 END AS block
  FROM (SELECT *, unnest(range(1, length(text) - 2)) AS k FROM c) u),
g4 AS (SELECT gram, sum(allow) AS allow, sum(block) AS block FROM o GROUP BY gram),
"""
    for n in (3, 2, 1):
        sql += f"g{n} AS (SELECT substr(gram, 2) AS gram, sum(allow) AS allow, sum(block) AS block FROM g{n + 1} GROUP BY substr(gram, 2)),\n"
    one = lambda s: f"(g.{s} + 1.0) / (sum(g.{s}) OVER () + count(*) OVER ())"
    sql += f"p1 AS (SELECT gram, {one('allow')} AS allow, {one('block')} AS block FROM g1 g),\n"
    for n in (2, 3, 4):
        total = lambda s: f"sum(g.{s}) OVER (PARTITION BY substr(g.gram, 1, {n - 1}))"  # noqa: B023, E731
        kinds = lambda s: f"sum(CASE WHEN g.{s} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY substr(g.gram, 1, {n - 1}))"  # noqa: B023, E731
        p = lambda s: f"CASE WHEN {total(s)} = 0 THEN p.{s} ELSE (g.{s} + {kinds(s)} * p.{s}) / ({total(s)} + {kinds(s)}) END AS {s}"  # noqa: B023, E731
        sql += f"p{n} AS (SELECT g.gram, {p('allow')}, {p('block')} FROM g{n} g JOIN p{n - 1} p ON substr(g.gram, 2) = p.gram),\n"
    share = lambda c: f"coalesce(sum({c}) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1.0 / nullif(sum({c}) OVER (), 0)"
    return sql + f"""
s AS (SELECT row, avg(ln(p4.allow) - ln(p4.block)) AS score FROM o JOIN p4 ON o.gram = p4.gram GROUP BY row),
t AS (SELECT c.*, floor(greatest(-20, least(20, s.score)) * 100) AS step FROM c JOIN s ON c.row = s.row),
n AS (SELECT step, sum(CASE WHEN says = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN says = 'block' THEN 1 ELSE 0 END) AS b FROM t WHERE says IS NOT NULL AND aside GROUP BY step),
m AS (SELECT step FROM (SELECT step, round({share("b")} - {share("a")}, 12) AS gain FROM n) x WHERE gain IS NOT NULL ORDER BY gain DESC, step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN step < (SELECT step FROM m) THEN 'block' ELSE 'allow' END) AS verdict FROM t
"""


#: The table of CRC-32 and the checksum of the bytes of a text, which SQL doesn't have: its bytes are pairs of hexadecimal digits that are folded one by one.
_CRC_TABLE = "t AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(text: str) -> str:
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST({digit(1)} * 16 + {digit(2)} AS bigint))"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, t.t[1 + xor(a & 255, b)]), CAST(4294967295 AS bigint)), 4294967295)"


def _op7_sql() -> str:
    order = "doc_id NULLS FIRST, crc, size, row"
    return f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS bigint) AS size, {_crc("coalesce(text, '')")} AS crc, row_number() OVER () AS row FROM documents, t),
s AS (SELECT *, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS til, sum(size) OVER () AS every FROM d),
p AS (SELECT *, CAST(((2 * til - size) * 40) // (2 * every) AS int) AS shard FROM s)
SELECT doc_id, size, CAST(crc AS bigint) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY {order}) - 1 AS bigint) AS slot, CAST(NULL AS int) AS grown_shard FROM p
"""


def _op6_sql() -> str:
    """While no more documents than FIT_ROWS can be learned from: beyond, the sample is drawn by a hash that SQL doesn't have."""
    n = language.LONGEST
    grams = lambda rows, more: f"SELECT {more}, n, substr(padded, CAST(k AS int), CAST(n AS int)) AS gram FROM (SELECT *, unnest(range(1, length(padded) - n + 2)) AS k FROM (SELECT *, ' ' || word || ' ' AS padded, unnest(range(1, {n + 1})) AS n FROM {rows}) a) b"
    return f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS row, doc_id, lang, text, doc_id IS NOT NULL AND {_crc("coalesce(CAST(doc_id AS varchar), '')")} % 3 = 1 AS held_out FROM documents, t),
w AS (SELECT row, lang, held_out, word, count(*) AS c FROM (SELECT row, lang, held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM d) u GROUP BY ALL),
l AS (SELECT lang, word, sum(c) AS c FROM w WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, word),
g AS (SELECT lang, 0 AS n, word AS gram, c FROM l UNION ALL SELECT lang, n, gram, sum(c) FROM ({grams("l", "lang, c")}) q GROUP BY lang, n, gram),
k AS (SELECT lang, n, gram, least({language.UNKNOWN}, -log10(c / sum(c) OVER (PARTITION BY lang, n))) AS cost FROM g),
langs AS (SELECT DISTINCT lang FROM g),
known AS (SELECT DISTINCT n, gram FROM g),
v AS (SELECT DISTINCT word FROM w),
seen AS (SELECT v.word FROM v JOIN known ON known.n = 0 AND known.gram = v.word),
late AS (SELECT * FROM v ANTI JOIN seen ON v.word = seen.word),
hits AS (SELECT h.word, h.n, h.gram FROM ({grams("late", "word")}) h JOIN known ON known.n = h.n AND known.gram = h.gram WHERE h.gram <> ' '),
best AS (SELECT word, max(n) AS n FROM hits GROUP BY word),
costs AS (
  SELECT seen.word, langs.lang, coalesce(k.cost, {language.UNKNOWN}) AS cost FROM seen CROSS JOIN langs LEFT JOIN k ON k.n = 0 AND k.gram = seen.word AND k.lang = langs.lang
  UNION ALL
  SELECT hits.word, langs.lang, avg(coalesce(k.cost, {language.UNKNOWN})) FROM hits JOIN best ON hits.word = best.word AND hits.n = best.n CROSS JOIN langs
    LEFT JOIN k ON k.n = hits.n AND k.gram = hits.gram AND k.lang = langs.lang GROUP BY hits.word, langs.lang),
sums AS (SELECT w.row, costs.lang, sum(w.c * costs.cost) * ln(10) / sqrt(sum(w.c)) AS cost FROM w JOIN costs ON w.word = costs.word GROUP BY w.row, costs.lang),
least_cost AS (SELECT row, min(cost) AS low FROM sums GROUP BY row),
said AS (SELECT s.row, min(CASE WHEN s.cost = m.low THEN s.lang END) AS lang, 1 / sum(exp(m.low - s.cost)) AS score FROM sums s JOIN least_cost m ON s.row = m.row GROUP BY s.row)
SELECT d.doc_id, d.held_out, CASE WHEN NOT regexp_matches(coalesce(d.text, ''), '\\p{{L}}') THEN 'und' ELSE coalesce(said.lang, (SELECT min(lang) FROM langs), 'und') END AS lang_pred,
  round(CASE WHEN NOT regexp_matches(coalesce(d.text, ''), '\\p{{L}}') THEN 0 ELSE coalesce(said.score, 1.0 / nullif((SELECT count(*) FROM langs), 0), 0) END, 6) AS score
FROM d LEFT JOIN said ON d.row = said.row
"""


def _op10_sql() -> str:
    """XXH64 by hand, over the distinct shingles: numbers are kept below 2**64 by remainders of 128-bit products."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    seed, top = 42, 1 << 64
    cut = lambda x: f"CAST(({x}) % CAST({top} AS uhugeint) AS ubigint)"
    big = lambda x: f"CAST({x} AS uhugeint)"
    number = lambda n: f"CAST({n % top} AS ubigint)"
    mul = lambda a, n: cut(f"{big(a)} * {big(n)}")
    add = lambda *xs: cut(" + ".join(map(big, xs)))
    turn = lambda a, r: f"({cut(f'{big(a)} * {1 << r}')} | ({a} >> {64 - r}))"
    # A list of one names a value, so that no expression is repeated.
    step = lambda a, x: f"list_transform([{add(a, mul(x, p2))}], lambda y: {mul(turn('y', 31), p1)})[1]"
    fold = lambda data, start, body: f"list_reduce({data}, lambda a, x: {body}, {start})"
    lanes = ", ".join(f"{fold(f'list_transform(range(n // 32), lambda i: w[4 * i + {k + 1}])', number(v), step('a', 'x'))} AS v{k}" for k, v in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1)))
    merged = "m0"
    merges = [f"*, {add(*(turn(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18))))} AS m0"]
    for k in range(4):
        mixed = f"xor({merged}, {step(number(0), f'v{k}')})"
        merged = f"m{k + 1}"
        merges.append(f"*, {add(mul(mixed, p1), number(p4))} AS {merged}")
    eight = f"list_transform([xor(a, {step(number(0), 'x')})], lambda y: {add(mul(turn('y', 27), p1), number(p4))})[1]"
    four = f"list_transform([xor(h, {mul('q', p1)})], lambda y: {add(mul(turn('y', 23), p2), number(p3))})[1]"
    one = f"list_transform([xor(a, {mul('x', p5)})], lambda y: {mul(turn('y', 11), p1)})[1]"
    word = lambda at, size: " + ".join(f"{big(f'b[{at} + {k}]')} * {1 << 8 * k}" for k in range(size))
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    stages = [
        f"s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST({digit(1)} * 16 + {digit(2)} AS ubigint)) AS b FROM distinct_shingles",
        "*, len(b) AS n FROM x0",
        f"*, list_transform(range(n // 8), lambda i: CAST({word('8 * i + 1', 8)} AS ubigint)) AS w FROM x1",
        f"*, {lanes} FROM x2",
        *(f"{m} FROM x{3 + k}" for k, m in enumerate(merges)),
        f"*, {add(f'CASE WHEN n >= 32 THEN m4 ELSE {number(seed + p5)} END', 'CAST(n AS ubigint)')} AS h0 FROM x8",
        f"*, {fold('w[4 * (n // 32) + 1 :]', 'h0', eight)} AS h FROM x9",
        f"*, CASE WHEN n % 8 >= 4 THEN CAST({word('8 * (n // 8) + 1', 4)} AS ubigint) END AS q FROM x10",
        f"s, n, b, CASE WHEN q IS NULL THEN h ELSE {four} END AS h FROM x11",
        f"s, {fold('b[4 * (n // 4) + 1 :]', 'h', one)} AS h FROM x12",
        f"s, {mul('xor(h, h >> 33)', p2)} AS h FROM x13",
        f"s, {mul('xor(h, h >> 29)', p3)} AS h FROM x14",
        "s, xor(h, h >> 32) AS h FROM x15",
    ]
    hashes = ",\n".join(f"x{k} AS (SELECT {x})" for k, x in enumerate(stages))
    bits = " | ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {number(1 << k)} ELSE {number(0)} END" for k in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS v FROM documents),
shingles AS (SELECT row, array_to_string(v, ' ') AS s FROM d WHERE len(v) BETWEEN 1 AND 3
  UNION ALL SELECT row, v[k] || ' ' || v[k + 1] || ' ' || v[k + 2] FROM (SELECT row, v, unnest(range(1, len(v) - 1)) AS k FROM d WHERE len(v) > 3) u),
distinct_shingles AS (SELECT DISTINCT s FROM shingles),
{hashes},
f AS (SELECT d.row, d.doc_id, coalesce(p.fp, {number(0)}) AS fp FROM d LEFT JOIN (SELECT row, {bits} AS fp FROM shingles JOIN x16 ON shingles.s = x16.s GROUP BY row) p ON d.row = p.row),
u AS (SELECT DISTINCT fp FROM f),
l AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON bit_count(xor(a.fp, b.fp)) <= 3),
r AS (SELECT fp, fp AS other FROM u UNION SELECT r.fp, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT r.fp, min(f.doc_id) AS component_id FROM r JOIN f ON f.fp = r.other GROUP BY r.fp)
SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, c.component_id FROM f JOIN c ON f.fp = c.fp
"""


def oracle_sql() -> dict[str, str]:
    """SQL has no greedy tiling, minimum cut, lattice search or grammar with learned weights: tests hold the other queries against brute force."""
    return {"op4_warc": _op4_sql(), "op6_language": _op6_sql(), "op7_sharding": _op7_sql(), "op8_knn": _OP8_SQL, "op9_urls": _op9_sql(), "op10_simhash": _op10_sql()}
