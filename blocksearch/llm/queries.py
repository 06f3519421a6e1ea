"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, licenses, merkle, mixing, packing, pieces, prefix_trie, quality, secret_scan, simhash, sstable, toxicity
from .common import crc_of_id, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_of_id() % 4 != 2)
    out = language.identify(docs, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(sstable.write(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    out = toxicity.predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_rows())


QUERIES = {
    "op1_language": op1_language,
    "op2_sstable": op2_sstable,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_pieces": op7_pieces,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_mixing": op12_mixing,
    "op13_manifest": op13_manifest,
}

def _secrets_sql() -> str:
    """Spans by what stands between the matches of each rule; as in the query,
    a match counts by the length of its group."""
    rules = " UNION ALL ".join(
        f"SELECT {i} AS rank, '{r.kind}' AS kind, '{p}' AS pattern, {r.least} AS least, {str(i < len(secret_scan.BASE)).lower()} AS base, {str(r.tail).lower()} AS tail, doc_id, text, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {r.group}) AS vals, string_split_regex(text, '{p}') AS gaps FROM t"
        for i, r in enumerate(secret_scan.RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({rules}),
             each AS (SELECT doc_id, rank, kind, least, base, tail, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM found),
             placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM each),
             begun AS (SELECT *, (stop - length(CASE WHEN tail THEN val ELSE hit END))::BIGINT AS start FROM placed WHERE length(val) >= least),
             spans AS (SELECT doc_id, rank, kind, base, start, kind || ':' || start || ':' || stop::BIGINT AS span FROM begun)
        SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
        FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id"""


def _quality_sql() -> str:
    """The counts, and the verdict line by line."""
    at = quality.Limits()
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = " OR ".join(f"contains({low}, '{p}')" for p in quality.BOILERPLATE)
    mark = " OR ".join(f"contains(line, '{c}')" for c in quality._MARKS)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
             runs AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t),
             again AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, w[i:i + 7]) > 1),
             covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY 1),
             lines AS (SELECT doc_id, line, regexp_extract_all(line, '{word}') AS v, length(line) - (length(line) - length(replace(line, ' ', ''))) AS size,
                              length(line) > {2 * at.long_line} AND length(line) - length(replace(line, ' ', '')) >= {at.long_line - 1} AS long, ({mark}) AS marked
                       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
             style AS (SELECT doc_id, 2 * count(*) FILTER (long AND marked) >= count(*) FILTER (long) AS marks,
                              count(*) FILTER (len(v) > 0) - count(DISTINCT line) FILTER (len(v) > 0) AS dup, sum(size) AS total FROM lines GROUP BY 1),
             judged AS (SELECT l.*, len(v) > 0 AND (
                              (length(line) - length(replace(line, '|', '')) > {at.separators} * len(v) AND length(line) - length(replace(line, '|', '')) > 1)
                           OR len(regexp_extract_all(line, '[#*$%&<>]{{2,}}')) > {at.symbol_words} * len(v)
                           OR (len(v) >= {at.capital_words} AND len(list_filter(v, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > {at.capitals} * len(v))
                           OR (len(v) >= {at.long_line} AND ((marks AND NOT marked) OR len(list_filter(range(1, len(v)), lambda i: v[i] = v[i + 1])) > {at.repeats} * len(v)))
                           OR {phrases}) AS fails FROM lines l JOIN style USING (doc_id)),
             lost AS (SELECT doc_id, coalesce(sum(size) FILTER (fails), 0) AS lost FROM judged GROUP BY 1),
             counted AS (SELECT t.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                                total, lost FROM t JOIN style USING (doc_id) JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {at.least_words} OR 100 * n_repeat_words > {at.repeated_percent} * n_words AS base_failed,
               NOT (n_words < {at.least_words} OR 100 * n_repeat_words > {at.repeated_percent} * n_words) AND lost <= {at.lost} * total AS kept FROM counted"""


def _crc(column: str) -> str:
    """SQL for the unsigned crc32 of a number as text, over ``bits`` of the table ``crc``."""
    steps = f"list_transform(string_split({column}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, bits[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _crc_table() -> str:
    """The byte table of crc32, by its rule: eight steps of a bit."""
    out = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        out = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({out})"
    return f"crc AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY i) AS bits FROM ({out}))"


def _trie_sql() -> str:
    """Nodes as lists of turns; a subtree is what begins with its top's list."""
    return f"""
        WITH {_crc_table()}, t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns FROM t GROUP BY 1),
             heads AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, ({_crc("conv_id")} % 6)::BIGINT AS h FROM own, crc),
             whole AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:c.h], c.turns[c.h + 1:]) AS p FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
             steps AS (SELECT conv_id, d, p[:d] AS n, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM whole)),
             nodes AS (SELECT n, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
             kids AS (SELECT n[:d - 1] AS n, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
             made AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(nodes.n[d].t) ELSE 0 END AS worth FROM nodes LEFT JOIN kids USING (n, d)),
             ups AS (SELECT n[:k] AS n, k AS d, worth, n_children FROM (SELECT n, worth, n_children, unnest(range(d + 1)) AS k FROM made)),
             sums AS (SELECT n, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(worth)::BIGINT AS saved_tokens FROM ups GROUP BY 1, 2)
        SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM made m JOIN sums USING (n, d) LEFT JOIN nodes u ON u.d = m.d - 1 AND u.n = m.n[:m.d - 1]"""


def _mix_sql() -> str:
    """Targets, slots and permuted blocks; which shard has a slot plays no part."""
    m, prime = mixing, mixing.PRIME
    line = lambda x, k: f"((({x}) % {prime}) * 48271 + (({x}) // {prime}) * 69621 + (({k}) % {prime}) * 16807 + 12345) % {prime}"
    mixed = lambda x, k: f"((({line(x, k)}) * (({line(x, k)}) % 1000003 + 7)) % {prime})"
    own, other = f"((sid * {m.MOST} + pass) * 1009 + r)", "((by_round[r + 1].pivot + blocks - i) % blocks)"
    weight = "[" + ", ".join(map(str, m.WEIGHTS)) + f"][sid % {len(m.WEIGHTS)} + 1]"
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '{m.WORD}')), 0)::BIGINT AS size FROM documents),
             placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS since FROM t),
             each AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM t GROUP BY 1),
             capped AS (SELECT *, {weight}::BIGINT AS weight, {m.MOST} * source_size AS cap FROM each),
             stops AS (SELECT *, (SELECT sum(source_size) FROM each) - coalesce(sum(cap) OVER early, 0) AS spare, sum(weight) OVER late AS heft, cap / weight AS stop FROM capped
                       WINDOW early AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), late AS (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
             level AS (SELECT spare, heft FROM stops WHERE spare / heft <= stop ORDER BY stop, sid LIMIT 1),
             aimed AS (SELECT *, least(cap::DOUBLE, (weight * (SELECT spare FROM level))::DOUBLE / (SELECT heft FROM level)) AS target, ceil(source_size / {m.BLOCK})::BIGINT AS blocks FROM capped),
             quota AS (SELECT *, CASE WHEN source_size > 0 THEN least({m.MOST} * blocks, floor(target * blocks / source_size + 0.5))::BIGINT ELSE 0 END AS slots FROM aimed),
             slots AS (SELECT sid, source, blocks, unnest(range(slots)) AS number FROM quota),
             keys AS (SELECT *, number // blocks AS pass FROM slots),
             passes AS (SELECT sid, pass, list_transform(range({m.ROUNDS}), lambda r: {{'pivot': ({mixed(own, m.SEED)} * {prime} + {mixed(own, m.SEED + 1)}) % blocks, 'times': {mixed(own, m.SEED + 2)} % 1048576 + 1, 'plus': {mixed(own, m.SEED + 3)}}}) AS by_round
                        FROM (SELECT DISTINCT sid, pass, blocks FROM keys)),
             blocks AS (SELECT source, list_reduce(range({m.ROUNDS}), lambda i, r: CASE WHEN ((greatest(i, {other}) * by_round[r + 1].times + by_round[r + 1].plus) % {prime} // 4096) % 2 = 1 THEN {other} ELSE i END, number % blocks) AS block FROM keys JOIN passes USING (sid, pass)),
             times AS (SELECT source, block, count(*) AS times FROM blocks GROUP BY 1, 2),
             parts AS (SELECT row, source, since, size, unnest(range(since // {m.BLOCK}, (since + size - 1) // {m.BLOCK} + 1)) AS block FROM placed WHERE size > 0),
             taken AS (SELECT row, sum((least(since + size, (p.block + 1) * {m.BLOCK}) - greatest(since, p.block * {m.BLOCK})) * times)::BIGINT AS taken
                       FROM parts p JOIN times t ON p.block = t.block AND p.source IS NOT DISTINCT FROM t.source GROUP BY 1)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source LEFT JOIN taken USING (row)"""


def _merkle_sql(levels: int = 6, upper: int = 3) -> str:
    """Trees as tables of levels, and a proof as a join with each level's run."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = "CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END"
    parts = []

    def tree(name: str, key: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{name}{k + 1} AS (SELECT {key}, pos // 16 AS pos, ceil(any_value(n) / 16)::BIGINT AS n, {up} AS d FROM {name}{k} GROUP BY {key}, pos // 16)")

    def climb(walk: str, name: str, key: str, count: int, start: str) -> str:
        last = start
        for k in range(count):
            parts.append(f"""{walk}{k} AS (SELECT w.row, any_value(w.source) AS source, any_value(w.k) AS k, any_value(w.pos) // 16 AS pos, any_value(w.proof) || coalesce(string_agg(l.d, '' ORDER BY l.pos) FILTER (l.pos <> w.pos), '') AS proof,
                CASE WHEN any_value(l.n) = 1 THEN any_value(w.fold) ELSE sha256(string_agg(CASE WHEN l.pos = w.pos THEN w.fold ELSE l.d END, '' ORDER BY l.pos)) END AS fold
                FROM {last} w JOIN {name}{k} l ON l.{key} = w.{key} AND l.pos // 16 = w.pos // 16 GROUP BY w.row)""")
            last = f"{walk}{k}"
        return last

    tree("l", "k", levels)
    parts.append(f"s0 AS (SELECT 0 AS source, k - 1 AS pos, count(*) OVER () AS n, d FROM l{levels})")
    tree("s", "source", upper)
    first = climb("w", "l", "k", levels, "docs")
    parts.append(f"over AS (SELECT row, 0 AS source, k, k - 1 AS pos, proof, fold FROM {first})")
    second = climb("v", "s", "source", upper, "over")
    return f"""
        WITH {_crc_table()}, t AS (SELECT row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) AS k, doc_id, {leaf("text")} AS leaf, {leaf(low)} AS other, coalesce({_crc("doc_id")} % 5 = 0, false) AS tampered FROM documents, crc),
             placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM t),
             l0 AS (SELECT k, pos, n, leaf AS d FROM placed), docs AS (SELECT row, 0 AS source, k, pos, '' AS proof, CASE WHEN tampered THEN other ELSE leaf END AS fold FROM placed), {", ".join(parts)}
        SELECT doc_id, leaf, l{levels}.d AS subroot, s{upper}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = s{upper}.d AS verified
        FROM placed JOIN {second} USING (row) JOIN l{levels} ON l{levels}.k = placed.k, s{upper}"""



ORACLE_SQL = {
    "op3_quality": _quality_sql(),
    "op6_secret_scan": _secrets_sql(),
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op11_prefix_trie": _trie_sql(),
    "op12_mixing": _mix_sql(),
    "op13_manifest": _merkle_sql(),
}
