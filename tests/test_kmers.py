import random

import pytest

from strandloom.operators import kmers as K

RC = str.maketrans("ACGTacgt", "TGCAtgca")


def genome(seed, lengths, tile, letters="ACGT"):
    """Tiles of chroms of which some tiles lack, and which the chroms are made of: position -> letter."""
    r = random.Random(seed)
    rows, at = [], {}
    for c, n in enumerate(lengths):
        seq = "".join(r.choice(letters) for _ in range(n))
        for t in range(0, -(-n // tile)):
            if t % 5 != 3:
                piece = seq[t * tile : (t + 1) * tile]
                rows.append((f"c{c}", t, piece))
                at |= {(f"c{c}", t * tile + i): x for i, x in enumerate(piece)}
    r.shuffle(rows)
    return rows, at


def expected(at, k, v):
    mers = {}
    for c, p in at:
        m = "".join(at.get((c, p + i), "N") for i in range(k))
        if "N" not in m:
            mers[c, p] = m
    every = [(x, 1, m) for x, m in mers.items()] + [(x, -1, m[::-1].translate(RC)) for x, m in mers.items()]
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    return {x for x, m in mers.items() if any(far(m, w) <= v for y, s, w in every if (y, s) != (x, 1))}


def spread(runs):
    rows = runs.collect()
    got = [(r["chrom"], p) for r in rows for p in range(r["start"], r["end"])]
    assert len(got) == len(set(got)) and all(r["start"] < r["end"] for r in rows)
    return set(got)


TILES = "chrom string, tile_no bigint, seq string"


@pytest.mark.parametrize("k,v,letters", [(4, 0, "ACGT" * 9 + "N"), (5, 0, "ACGT"), (7, 1, "ACGT" * 9 + "N"), (6, 1, "ACGT"), (12, 0, "A" * 9 + "C"), (4, 0, "ACGT" * 9 + "a"), (6, 2, "ACGT")])
def test_repeat_runs(spark, monkeypatch, k, v, letters):
    monkeypatch.setattr(K, "STRETCH", 30)  # borders between stretches, tiles, rounds and buckets
    monkeypatch.setattr(K, "ROUND", 150)
    monkeypatch.setattr(K, "BUCKET", 40)
    monkeypatch.setattr(K, "PART", 64)
    rows, at = genome(k, (90, 41, 3), 6, letters)
    runs = K.repeat_runs(spark.createDataFrame(rows, TILES), k, 6, v)
    want = expected(at, k, v)
    assert want and spread(runs) == want
    sums = {r["chrom"]: (r["n_repeated"], r["pos_sum"]) for r in K.repeat_sums(runs).collect()}
    assert sums == {c: (sum(x == c for x, _ in want), sum(p for x, p in want if x == c)) for c in {c for c, _ in want}}
    masks = K.repeat_masks(runs, k, 1).collect()
    for strand, by in (("+", 1), ("-", k - 2)):
        own = sorted((m["chrom"], m["start"] - by, m["end"] - by) for m in masks if m["strand"] == strand)
        assert {(c, p) for c, s, e in own for p in range(s, e)} == want
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(own, own[1:]))


def test_unusual_genomes(spark):
    none = K.repeat_runs(spark.createDataFrame([], TILES), 4, 8)
    assert none.count() == 0 and K.repeat_masks(none, 4).count() == 0
    assert K.repeat_runs(spark.createDataFrame([], TILES), 12, 8, 1).count() == 0
    short = spark.createDataFrame([("c", 0, "ACG"), ("d", 2, ""), ("e", 0, None)], TILES)
    assert K.repeat_runs(short, 4, 8).count() == 0
    own = spark.createDataFrame([(None, 3, "ACGTNNNN"), ("d", -1, "NNNNNNCC"), ("d", 0, "CCNNNNNN")], TILES)
    assert {(r["chrom"], r["start"], r["end"]) for r in K.repeat_runs(own, 4, 8).collect()} == {(None, 24, 25)}
    with pytest.raises(Exception, match="more than 8"):
        K.repeat_runs(spark.createDataFrame([("c", 0, "A" * 9)], TILES), 4, 8).collect()


def written(spark, f):
    """Bytes of shuffle files that f makes."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def total():
        bus.waitUntilEmpty(30_000)
        all_stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(all_stages.apply(i).shuffleWriteBytes() for i in range(all_stages.size()))

    before = total()
    f()
    return total() - before


def many_tiles(spark, n):
    return spark.range(n).selectExpr("'c' AS chrom", "id AS tile_no", "translate(md5(CAST(id AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq")


def test_counts_and_masks_exchange_less_than_the_letters(spark):
    """No row a k-mer, a letter or a position is shuffled."""
    n = 20_000
    g = many_tiles(spark, n)
    assert written(spark, lambda: K.repeat_sums(K.repeat_runs(g, 6, 32)).collect()) < 32 * n
    assert written(spark, lambda: K.repeat_masks(K.repeat_runs(g, 6, 32), 6).collect()) < 32 * n


def test_rounds_bound_what_is_on_disk(spark, monkeypatch):
    n = 20_000
    monkeypatch.setattr(K, "ROUND", 2 * 32 * n // 4)
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        every = files.getAllFiles()
        return sum(every.apply(i).getName().startswith("shuffle_") for i in range(every.size()))

    before, most, kept = held(), [], K.materialize

    def materialize(df, label):
        most.append(held() - before)
        return kept(df, label)

    monkeypatch.setattr(K, "materialize", materialize)
    # Two strands, 8 or 9 bytes a k-mer.
    assert written(spark, lambda: K.repeat_runs(many_tiles(spark, n), 20, 32, 1)) < 20 * 32 * n
    assert len(most) == 4 and max([*most, held() - before]) <= 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_a_monotone_genome_makes_no_large_bucket(spark, monkeypatch):
    seen = K._halves(0, 1, 1, 20, 8, 8, K.np.uint16)
    tiles = K.pa.table({"chrom": ["c"] * 9, "tile_no": range(9), "seq": ["A" * 8] * 9})
    parts = K.pa.Table.from_batches(K._packer(8, 8, 3, K.np.uint16)(iter(tiles.to_batches())))
    own = K._gather(8, K.np.uint16, 8)(None, parts.filter(K.pc.equal(parts["block"], 0)))
    rows = [r for b in seen(iter(own.to_batches())) for r in b.to_pylist()]
    assert sorted((r["bucket"], len(r["words"]), len(r["offs"])) for r in rows) == [(-1, 0, 2 * 53 * 4), (0, 2 * 5, 2 * 4)]
    monkeypatch.setattr(K, "STRETCH", 4096)
    g = spark.range(500).selectExpr("'c' AS chrom", "id AS tile_no", "repeat('A', 32) AS seq")
    assert [tuple(r) for r in K.repeat_masks(K.repeat_runs(g, 20, 32, 1), 20).filter("strand = '+'").collect()] == [("c", "+", 0, 500 * 32 - 19)]
