import random
import re
from collections import Counter

from farebox.llm import decontaminate as D


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", folded) if w]


def brute(rows, items):
    out = []
    for _, text in rows:
        own, found = words(text), {}
        for item, wanted in items:
            w = words(wanted)
            if item is None or not w:
                continue
            n, size = len(w), min(5, len(w))
            want = Counter(tuple(w[k:k + size]) for k in range(n - size + 1))
            for k in range(len(own) - n + 1):
                have = Counter(tuple(own[j:j + size]) for j in range(k, k + n - size + 1))
                both = sum((want & have).values())
                similarity = both / (sum(want.values()) + sum(have.values()) - both)
                if similarity >= 0.75 and (-similarity, k) < (-found.get(item, (0, 0))[0], found.get(item, (0, 0))[1]):
                    found[item] = (similarity, k, k + n)
        out.append(sorted((i, a, b, round(s, 9)) for i, (s, a, b) in found.items()))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(40)]
    items += [(50, None), (None, "some text"), (51, ""), (52, "two  words"), (3, "another wording of item three " * 3), (53, items[0][1])]
    rows = []
    for i in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            put = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if put:
                    put[rng.randrange(len(put))] = rng.choice(vocabulary)
            at = rng.randint(0, len(own))
            own = own[:at] + [w.upper() for w in put] + own[at:]
        rows.append((i % 100, " ".join(own)))
    rows += [(None, items[7][1]), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, zip([i for i, _ in rows], [len(words(t)) for _, t in rows], brute(rows, items))))

    def got():
        return sorted(str((r["doc_id"], r["n_words"], [(m["item_id"], m["start"], m["end"], round(m["similarity"], 9)) for m in r["matches"]]))
                      for r in D.contamination(docs, bench).collect())

    assert got() == want
    monkeypatch.setattr(D, "ITEM_BYTES", 2000)
    assert got() == want
    assert D.clean(docs, bench).count() == sum("[])" in w for w in want)


def test_edges(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, docs.where("doc_id = 9").first()["text"])], "item_id long, text string")
    out = D.contamination(docs, bench)
    assert out.count() == docs.count()
    assert {r["doc_id"] for r in out.where("size(matches) > 0").collect()} == {9, 10}
    clean = D.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert D.contamination(no_docs, bench).count() == 0 and D.clean(docs, bench.limit(0)).count() == docs.count()


def test_index_reaches_the_radius():
    near = D._NEAR
    assert D.RADIUS // D.BLOCKS == 2 and all(near[v, w] == (bin(v ^ w).count("1") <= 2) for v in range(0, 256, 7) for w in range(256))


def brute_short(text, items):
    """As brute, for items with more words than the text: the whole text is the window."""
    own, found = words(text), {}
    for item, wanted in items:
        w = words(wanted)
        size = min(5, len(w))
        if len(own) < len(w):
            want = Counter(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
            have = Counter(tuple(own[k:k + size]) for k in range(len(own) - size + 1))
            both = sum((want & have).values())
            similarity = both / (sum(want.values()) + sum(have.values()) - both)
            if similarity >= 0.75 and similarity > found.get(item, (0,))[0]:
                found[item] = (similarity, 0, len(own))
    return sorted((i, a, b, round(s, 9)) for i, (s, a, b) in found.items())


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(60)]
    items += [(60, " ".join(rng.choices(vocabulary, k=40))), (61, "again and " * 20)]
    rows = [(i, " ".join(items[60][1].split()[:40 - cut])) for i, cut in enumerate((1, 2, 4, 8, 9, 10, 36))]
    rows += [(50, "again and " * 18), (51, "again and " * 3)]
    for i in range(100, 400):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, 10)):
            if len(own) > 1:
                del own[rng.choice([0, -1, rng.randrange(len(own))])]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [(m["item_id"], m["start"], m["end"], round(m["similarity"], 9)) for m in r["matches"]]
           for r in D.contamination(docs, bench).collect()}
    want = {i: brute_short(t, items) for i, t in rows}
    assert got == want
    assert [len(want[i]) for i in range(7)] == [1, 1, 1, 1, 1, 0, 0] and len(want[50]) == 1
    assert sum(map(bool, want.values())) > 50
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == {i for i, m in want.items() if not m}


def test_wordings_of_an_item_in_different_parts(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=20 + k)) for k in range(12)]
    items = [(k % 3, t) for k, t in enumerate(texts)]
    flawed = texts[0].split()
    flawed[10] = "changed"
    rows = [(1, " ".join(texts)), (2, " ".join([*flawed, texts[3], texts[6]])), (3, "nothing here"), (4, texts[5] + " " + texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def got():
        return sorted((r["doc_id"], r["n_words"], [tuple(m) for m in r["matches"]]) for r in D.contamination(docs, bench).collect())

    whole = got()
    assert [len(m) for _, _, m in whole] == [3, 1, 0, 2]
    monkeypatch.setattr(D, "ITEM_BYTES", 400)
    assert all(len(p) < len(items) for p in D._parts(bench))
    assert got() == whole


def test_sql_twin_knows_short_documents(spark, tmp_path):
    """The registered SQL on documents that are an item, a part of one, or hold one."""
    import sys
    from pathlib import Path
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    from oracle_check import compare, duck

    from farebox.llm import queries as Q

    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([40, 12, 5, 3, 25, 40])]
    docs = []
    for k, text in items:
        own = text.split()
        for cut in (0, 1, 2, 4, len(own) // 2):
            docs.append(" ".join(own[cut:]))
            docs.append(" ".join(own[:len(own) - cut]).upper())
            docs.append(" ".join([*rng.choices(words, k=30), *own[cut:], *rng.choices(words, k=9)]))
    docs += [None, "", "w1 w2", " ".join(rng.choices(words, k=300))]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "items"))
    for name, folder in (("documents", "docs"), ("benchmark", "items")):
        part = next((tmp_path / folder).glob("part-*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    con = duck(str(tmp_path))
    assert compare(spark, con, "op6_decontaminate", Q.op6_decontaminate, Q.ORACLE["op6_decontaminate"], str(tmp_path))
    assert Q.op6_decontaminate(spark, str(tmp_path)).where("contaminated and n_words < 40").count() > 15
