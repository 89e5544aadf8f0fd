import random

import xxhash

from quadrille.llm import simhash
from quadrille.llm.queries import op2_simhash
from tests.llm import cases


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """prints: fingerprint by row."""
    distinct = sorted(set(prints))
    up = {x: x for x in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = [0, *(1 << a for a in range(64)), *((1 << a) | (1 << b) for a in range(64) for b in range(a))]
    for x in distinct:
        for m in near:
            if x ^ m in up:
                up[find(x)] = find(x ^ m)
    return {x: find(x) for x in distinct}


def check(rows, texts):
    prints = [(i, brute_print(t)) for i, t in texts]
    root = brute_classes([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((repr(i), f"{p:016x}", least.get(root[p])) for i, p in prints)


def test_query_equals_brute_force(spark, sf_dir):
    check(op2_simhash(spark, sf_dir).collect(), cases.documents(spark, sf_dir))


def test_awkward_rows(spark):
    check(simhash.classes(cases.frame(spark)).collect(), [r[:2] for r in cases.rows()])


def test_empty_table(spark):
    assert simhash.classes(cases.frame(spark).limit(0)).count() == 0


def test_links_of_dense_files_are_whole(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        x = r.choice(sorted(prints))
        prints.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    want = sorted((simhash._signed(a), simhash._signed(b)) if simhash._signed(a) < simhash._signed(b) else (simhash._signed(b), simhash._signed(a)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    for dense in (2, 8, 64):
        assert sorted(map(tuple, simhash.links(frame, dense).collect())) == want


def test_one_document_of_a_class_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "A b c d"), (2, "quite another text here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 2]
