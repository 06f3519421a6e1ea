"""The manifest and its proofs against trees made as a whole."""

import hashlib
import random
import zlib

from blocksearch.llm import merkle as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, leaf string, name string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((at - first, level[first : first + 16]))
        at //= 16
    return out


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]))) for s in order}
    trees = {s: climb([leaf(r[0], r[3], r[2], r[4], r[1]) for r in made[s]]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        over = path_of(top, i)
        for at, r in enumerate(made[s]):
            path = path_of(trees[s], at) + over
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r[0], r[3], r[2], r[4], lowered(r[1]) if changed else r[1])
            for place, run in path:
                fold = h([*run[:place], fold, *run[place + 1 :]])
            proof = h(x for place, run in path for j, x in enumerate(run) if j != place)
            out.append((r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=str)


def rows(hot=5000):
    rng = random.Random(1)
    out = [(i, f"Text {i} É😀" + "X" * rng.randrange(30), "en" if i % 3 else None, "hot" if i % 3 else "cold", i % 7 or None, 1, "l", "n") for i in range(hot)]
    out += [(10_000 + i, "Lone" if i % 2 else "lone", "en", f"s{i}", 1, 1, "l", "n") for i in range(40)]
    out += [(None, "A", None, None, None, 1, "l", "n"), (None, None, None, None, None, 1, "l", "n"), (7, "twice", "en", "é", 5, 1, "l", "n"), (7, "twice", "en", "é", 5, 1, "l", "n"), (7, "Once", "en", "é", 5, 1, "l", "n")]
    out += [(20_000 + i, "", "", "", 0, 1, "l", "n") for i in range(17)] + [(30_000, "Z" * 100_000, "en", "", 3, 1, "l", "n")]
    return out


def got(spark, some, parts=6):
    df = spark.createDataFrame(some, SCHEMA).repartition(parts)
    return sorted(map(tuple, op.manifest(df, op.tampered_rows()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_against_whole_trees(spark):
    assert got(spark, rows(14_000)) == plain(rows(14_000))  # over two blocks in the hot source, over one in the other


def test_small(spark):
    for n in (1, 2, 16, 17):
        some = [(i, "Ab", "en", "s", 2, 0, "", "") for i in range(n)]
        assert got(spark, some, 2) == plain(some)
    assert got(spark, []) == []
    kept = op.manifest(spark.createDataFrame(rows(50), SCHEMA))
    assert kept.where("not verified").count() == 0 and kept.count() == len(rows(50))


def test_paths_hold_few_nodes():
    leaves = [f"{i:064x}" for i in range(5000)]
    levels = climb(leaves)
    for t, path in enumerate(op.paths(leaves, 4)):
        assert path == path_of(levels, t)
    grown = op.Growing(leaves, 3, 0)
    while grown.at < grown.stop:
        grown.step()
        assert all(len(x) <= op.FAN for x in grown.stack)
