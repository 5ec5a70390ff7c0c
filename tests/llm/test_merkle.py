"""The Merkle manifest against plain loops, and its proofs as a checker would use them."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from upswell.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(level, proofs):
    """The root over a list of digests; ``proofs[i]`` gets (left, right) per level of node i."""
    at = list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            proofs[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0]


def by_hand(rows):
    """Per row of the query, sorted."""
    trees = {}
    for row in rows:
        trees.setdefault(row.source, []).append(row)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots, own = [], {}
    for key in keys:
        mine = sorted(trees[key], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        own[key] = mine, [[] for _ in mine]
        subroots.append(climbed([leaf(r, r.text) for r in mine], own[key][1]))
    above = [[] for _ in subroots]
    root = climbed(list(subroots), above)
    out = []
    for key, subroot, rest in zip(keys, subroots, above):
        for row, proof in zip(*own[key]):
            proof = proof + rest
            text = row.text
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for left, right in proof:
                folded = sha(left, folded, right)
            siblings = sha(*(left + right for left, right in proof))
            out.append((row.doc_id, leaf(row, row.text), subroot, root, siblings, folded, folded == root))
    return sorted(out, key=repr)


def queried(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.select(names).collect()), key=repr)


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queried(spark, docs, tmp_path) == by_hand(docs.collect())


def test_nulls_repeats_and_lone_leaves(spark, tmp_path):
    rows = [
        (1, None, "en", 3, "a\nb"), (None, None, None, None, None), (None, "b", "en", None, "x\ny\n"), (2, "", "en", 0, ""),
        (7, "Zoë", "de", 5, "größe\n😀"), (7, "Zoë", "de", 5, "größe\n😀"), (7, "Zoë", "de", 5, "other\ntext"), (8, "zoë", "xx", 1, "\n" * 100_000),
        *[(100 + i, "many", "en", i, f"line\n{i}") for i in range(83)],
    ]
    frame = spark.createDataFrame(rows, DOCS)
    assert queried(spark, frame.repartition(5), tmp_path) == by_hand(frame.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
@pytest.mark.parametrize("trees", [1, 4])
def test_sizes(spark, n, trees):
    """Trees of every shape, with storeys of one, two and six levels."""
    rows = spark.range(n * trees).selectExpr("id", "cast(id % " + str(trees) + " as string) as part", "unhex(sha2(string(id), 256)) as leaf", "id as array")
    expected = {}
    tops = []
    for t in range(trees):
        ids = range(t, n * trees, trees)
        proofs = [[] for _ in ids]
        tops.append(climbed([sha(str(i)) for i in ids], proofs))
        expected |= dict(zip(ids, proofs))
    above = [[] for _ in tops]
    root = climbed(list(tops), above)
    for stride in (1, 2, 6) if n > 4 else (2,):
        found = merkle.climb(*merkle.manifest(rows, "part", "id", stride=stride))
        got = {r.row.id: r for r in found.collect()}
        assert len(got) == n * trees
        for i, r in got.items():
            assert [(s.left.hex(), s.right.hex()) for s in r.proof] == expected[i] + above[i % trees]
            assert r.root.hex() == root and r.folded == r.root and r.subroot.hex() == tops[i % trees]


def test_a_claim_holds_only_if_it_is_the_leaf(spark):
    rows = spark.range(50).selectExpr("id", "'s' as part", "unhex(sha2(string(id), 256)) as leaf", "unhex(sha2(string(if(id = 7, 8, id)), 256)) as claimed")
    found = merkle.climb(*merkle.manifest(rows, "part", "id", stride=2), "row.claimed")
    wrong = found.where(F.col("folded") != F.col("root")).select("row.id").collect()
    assert [r.id for r in wrong] == [7]
    # A proof alone is enough for somebody who has the root.
    again = found.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert {r.ok for r in again.collect()} == {True}


def test_encoding_is_unambiguous(one):
    values = one(*[merkle.encoded(F.lit(v).cast("string")) for v in (None, "-", "", "1:a", "é")])
    assert values == ("-", "1:-", "0:", "3:1:a", "2:é")


def test_empty_table_and_recursion_limit(spark, monkeypatch):
    rows = spark.range(0).selectExpr("id", "'s' as part", "unhex('') as leaf")
    leaves, nodes = merkle.manifest(rows, "part", "id")
    assert leaves.count() == 0 and merkle.climb(leaves, nodes).collect() == []
    # Spark stops a recursion at a million rows unless told otherwise.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    rows = spark.range(200).selectExpr("id", "'s' as part", "unhex(sha2(string(id), 256)) as leaf")
    assert merkle.climb(*merkle.manifest(rows, "part", "id", stride=2)).count() == 200
