import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from farebox.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof_of(levels, i):
    steps = []
    for nodes in levels[:-1]:
        low = i - i % 3
        steps.append((nodes[low:i], nodes[i + 1:low + 3]))
        i //= 3
    return steps


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of (doc_id, source, lang, n_chars, text) rows."""
    by_source = {}
    for row in rows:
        doc_id, text = row[0], row[4]
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        leaf, other = (h(*map(field, (doc_id, row[1], row[2], row[3], t))) for t in (text, changed))
        by_source.setdefault(row[1], []).append((doc_id is not None, doc_id or 0, leaf, other))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by_source[s])]) for s in sources]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, (s, tree) in enumerate(zip(sources, trees)):
        for i, (known, doc_id, leaf, other) in enumerate(sorted(by_source[s])):
            steps = proof_of(tree, i) + proof_of(top, k)
            folded = other
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((doc_id if known else None, leaf, tree[-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), folded))
    return out


def found(out):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], h(*[x for s in r["path"] for x in (s["left"], s["right"])]), r["folded_root"])
            for r in out.collect()]


def made(sizes):
    """Rows of sources of given sizes, out of order."""
    rows = []
    for k, n in enumerate(sizes):
        for i in range(n):
            rows.append((1000 * k + (7 * i) % max(n, 1) * 3, None if k == 1 else f"s{'é' * (k % 3)}{k}", None if i % 5 == 0 else "en",
                         None if i % 7 == 0 else i, None if i % 11 == 0 else "" if i % 13 == 0 else f"a line\n{i}\n" if i % 2 else f"no break {i}"))
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4, 1], [243], [244, 3], [1, 9, 10, 28, 82], [730, 5, 1, 243, 486, 487]])
def test_against_brute_force(spark, sizes):
    rows = made(sizes)
    got = found(M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_many_levels_and_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 3)
    sizes = [30, 1, 2, 3, 4, 5, 10, 28, 1, 1, 1, 9]
    rows = made(sizes)
    # Workers read the module's constants anew, so blocks of three are tested in this process.
    for n in range(1, 40):
        leaves = [h(str(i)) for i in range(n)]
        levels, nodes = levels_of(leaves), leaves
        while len(nodes) > 1:
            nodes = [M.Tree.block(k, nodes[3 * k:3 * k + 3]).root for k in range(-(-len(nodes) // 3))]
        assert nodes[0] == levels[-1][0]
    monkeypatch.undo()
    assert sorted(found(M.manifest(spark.createDataFrame(rows, SCHEMA))), key=repr) == sorted(brute(rows), key=repr)


def test_edge_rows(spark, docs, no_docs):
    out = M.manifest(docs)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    assert sorted(found(out), key=repr) == sorted(brute(rows), key=repr)
    assert M.manifest(no_docs).count() == 0
    repeated = [(5, "a", "en", 1, "x\ny")] * 40 + [(5, "a", "en", 1, "other")] * 3
    assert sorted(found(M.manifest(spark.createDataFrame(repeated, SCHEMA))), key=repr) == sorted(brute(repeated), key=repr)


def test_versions_share_untouched_nodes(spark):
    """A version copies one node a level; copies differ from the original only where the leaf was tampered with."""
    rows = made([300, 20])
    out = M.manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("height", F.size("path")).collect()
    assert all(len(r["copies"]) == r["height"] for r in out)
    assert any(r["tampered_leaf"] for r in out)
    assert all((r["tampered_leaf"] is None) == (r["folded_root"] == r["root"]) for r in out)
    assert len({r["folded_root"] for r in out if r["tampered_leaf"]}) == sum(r["tampered_leaf"] is not None for r in out)
