"""SimHash: fingerprints by their definition, components by all pairs."""

import random
from collections import Counter

import pytest
import xxhash

from gainsieve.llm.components import connected_components
from gainsieve.llm.simhash import BKTree, _masks, fingerprint, near_duplicates, near_links


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_all_near(seed):
    dice = random.Random(seed)
    values = {dice.getrandbits(10) for _ in range(300)}
    tree = BKTree(values)
    for query in range(0, 1024, 7):
        assert sorted(tree.near(query, 3)) == sorted(v for v in values if (v ^ query).bit_count() <= 3)


@pytest.mark.parametrize("part", [4, 1000])
def test_links_connect_all_near(spark, part):
    dice = random.Random(part)
    values = {dice.getrandbits(64) for _ in range(40)} | {0}
    for v in list(values):
        for _ in range(6):
            flipped = v
            for b in dice.sample(range(64), dice.randint(1, 4)):
                flipped ^= 1 << b
            values.add(flipped)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(near_links(table, 3, part)).collect()}
    linked = [(signed(a), signed(b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    expected = plain_components(map(signed, values), linked)
    assert {signed(v): got.get(signed(v), signed(v)) for v in values} == expected
    assert len(_masks(3)) == 10


def test_long_path(spark):
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_documents(spark, frame, documents):
    fps = [(k, plain_fingerprint(t)) for k, t in documents]
    assert [fingerprint(t) for _, t in documents] == [f for _, f in fps]
    least = {}
    for k, f in fps:
        least[f] = min(k, least.get(f, k))
    label = plain_components(least.values(), [(least[a], least[b]) for a in least for b in least if a < b and (a ^ b).bit_count() <= 3])
    expected = Counter((k, f"{f:016x}", label[least[f]]) for k, f in fps)
    assert Counter(tuple(r) for r in near_duplicates(frame, "doc_id").collect()) == expected
    assert near_duplicates(frame.limit(0), "doc_id").count() == 0
