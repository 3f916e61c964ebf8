import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farebox.llm import fill_in_middle as M


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_brute_force(spark, docs, no_docs, rows):
    rng = random.Random(1)
    more = [(1000 + i, "".join(rng.choices(["a", "é", "日", "\U0001f600", "<", "P", ">", "<S", "\x00", "\n", "<M>" if i % 9 == 0 else "M"],
                                           k=rng.randint(0, 60)))) for i in range(300)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = M.transform(frame).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect()), key=repr)
    assert got == sorted(((str(i), *brute(i, t), t or "") for i, t in rows + more), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.transform(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert M.transform(no_docs).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_rank_and_select(texts):
    """Every unit's end, in texts that lie one behind the other."""
    whole = "".join(texts)
    buf = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    index = M.UnitIndex(buf)
    places = np.cumsum([0] + [len(c.encode("utf-8", "surrogatepass")) for c in whole])
    assert index.select(np.arange(len(whole) + 1)).tolist() == places.tolist()
    assert index.rank(places).tolist() == list(range(len(whole) + 1))
