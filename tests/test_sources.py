import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.annotation import assemble_transcripts
from strandloom.sources import binary as B
from strandloom.sources import sinks as K
from strandloom.sources import text as X
from strandloom.sources.spans import read_tabix


@pytest.fixture()
def put(tmp_path):
    def f(name, text):
        p = tmp_path / name
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(p)

    return f


def lines(df):
    return [r["line"] for r in df.collect()]


def test_bed(spark, put):
    p = put("a.bed", "track name=x\n#c\n\nchr1\t5\t9\nchr1\t5\t40\tn\t3.5\t-\t6\t20\t255,0,10\t2\t5,10,\t0,25,\nchr1\tx\t9\nchr1\t9\t5\nchr1\t1\nchr1\t0\t30\tq\t0\t+\t0\t0\t0\t2\t5\t0,9\n")
    ok, bad = X.read_bed(spark, p)
    r = {x["ID"]: x for x in ok.collect()}
    assert set(r) == {"chr1:5-9(.)", "n"} and bad.count() == 4
    assert r["n"]["color"] == "#ff000a" and [tuple(s) for s in r["n"]["segments"]] == [(5, 10), (30, 40)] and (r["n"]["thick_start"], r["n"]["thick_end"]) == (6, 20)
    assert lines(K.as_bed(ok.filter("ID = 'n'"), score="score", color="color", thick=("thick_start", "thick_end"))) == ["chr1\t5\t40\tn\t4\t-\t6\t20\t255,0,10\t2\t5,10,\t0,25,"]
    e = put("b.bed", "c\t1\t2\tp\t0\t+\t1.5\t2\tbad\t7\n")
    x = X.read_bed(spark, e, subtype="narrowPeak")[0].collect()[0]
    assert (x["signalValue"], x["qValue"], x["peak"], x["attr"]["qValue"]) == (1.5, None, 7, "bad")
    assert X.read_bed(spark, put("c.bed", "c\t1\t2\tz\n"), extra=1)[0].collect()[0]["custom0"] == "z"


def test_gtf_round_trip(spark, put):
    t = spark.createDataFrame([("c", "-", [(0, 10), (20, 30), (40, 50)], 5, 45, {"gene_id": 'g"1', "transcript_id": "t1", "note": "a;b"})], f"chrom string, strand string, segments {C.SEGMENTS}, cds_genome_start bigint, cds_genome_end bigint, attr map<string,string>")
    out = lines(K.transcript_as_gtf(t))
    ok, bad = X.read_gtf(spark, put("a.gtf", "\n".join(out) + "\n"))
    rows = ok.collect()
    assert bad.count() == 0 and {r["gene_id"] for r in rows} == {'g"1'} and {r["attr"]["note"] for r in rows} == {"a;b"}
    assert sorted((r["start"], r["end"]) for r in rows if r["feature_type"] == "exon") == [(0, 10), (20, 30), (40, 50)]
    assert [(r["start"], r["end"]) for r in rows if r["feature_type"] == "stop_codon"] == [(5, 8)]
    assert sorted((r["start"], r["end"], r["phase"]) for r in rows if r["feature_type"] == "CDS") == [(8, 10, 0), (20, 30, 1), (40, 45, 0)]
    tx, rejects = assemble_transcripts(ok)
    x = tx.collect()[0]
    assert ([tuple(s) for s in x["segments"]], x["cds_genome_start"], x["cds_genome_end"]) == ([(0, 10), (20, 30), (40, 50)], 5, 45) and rejects.count() == 0


def test_gff3(spark, put):
    p = put("a.gff", "##gff-version 3\n##sequence-region c 1 99\nc\ts\tmRNA\t1\t50\t.\t+\t.\tID=m%3B1;Parent=g1,g2;Note=x;Note=y\nbad\tline\n##FASTA\n>c\nACGT\n")
    ok, bad = X.read_gff3(spark, p)
    r = ok.collect()[0]
    assert (r["ID"], r["parents"], r["attr"]["Note"], r["start"], r["end"]) == ("m;1", ["g1", "g2"], "x,y", 0, 50) and bad.count() == 1
    assert {(x["directive"], x["value"]) for x in X.read_gff3_metadata(spark, p).collect()} >= {("gff-version", "3"), ("sequence-region", "c 1 99")}
    t = spark.createDataFrame([("c", "+", [(0, 10)], None, None, {"ID": "a=b"}, "a=b")], f"chrom string, strand string, segments {C.SEGMENTS}, cds_genome_start bigint, cds_genome_end bigint, attr map<string,string>, ID string")
    out = lines(K.transcript_as_gff3(t))
    assert out[0].endswith("ID=a%3Db") and out[1].endswith("ID=a%3Db:exon:0;Parent=a%3Db")
    assert lines(K.as_gff3(t))[0].split("\t")[3:5] == ["1", "10"]
    with pytest.raises(Exception, match="one segment"):
        K.as_gff3(t.withColumn("segments", F.concat("segments", "segments"))).collect()


def test_psl_and_bowtie(spark, put):
    line = "\t".join("12 1 0 0 0 0 1 5 -+ q1 20 0 13 chrA 99 10 28 2 7,6, 0,7, 10,22,".split())
    ok, bad = X.read_psl(spark, put("a.psl", "psLayout\n\nmatch\n---\n" + line + "\n" + "5\tx\n"))
    r = ok.collect()[0]
    assert (r["strand"], [tuple(s) for s in r["segments"]]) == ("+", [(10, 17), (22, 28)]) and bad.count() == 1
    assert X.bundle_psl(ok).count() == 1
    assert lines(K.as_psl(ok))[0].split("\t")[-1] == "10,22,"
    ok, bad = X.read_bowtie(spark, put("a.bwt", "r1\t-\tc\t7\tACGT\tIIII\t0\t1:A>C\nr2\t?\tc\tx\tA\n"))
    assert [(r["start"], r["rlen"], r["mismatches"]) for r in ok.collect()] == [(7, 4, "1:A>C")] and bad.count() == 1


def test_wiggle(spark, put):
    p = put("a.wig", "track type=wiggle_0\nvariableStep chrom=c span=2\n5 1.5\n9 2\nfixedStep chrom=d start=3 step=5 span=2\n1\n2\nx y z\nc 0 4 7\n")
    ok, bad = X.read_wiggle(spark, p, "+")
    assert {(r["chrom"], r["start"], r["end"], r["value"]) for r in ok.collect()} == {("c", 4, 6, 1.5), ("c", 8, 10, 2.0), ("d", 2, 4, 1.0), ("d", 7, 9, 2.0), ("c", 0, 4, 7.0)}
    assert lines(bad) == ["x y z"]
    g = put("a.bg", "c 0 4 7\nc 4 x 7\n")
    assert X.read_bedgraph(spark, g)[0].count() == 1 and X.read_bedgraph(spark, g)[1].count() == 1
    assert lines(K.as_bedgraph(ok.filter("chrom = 'd'")).orderBy("start")) == ["d\t2\t4\t1", "d\t7\t9\t2"]


def test_sequences(spark, put):
    p = put("a.fa", ">c1 first\nACGT\nAC\n>c2\nGG\n")
    got = {r["name"]: (r["description"], r["seq"]) for r in X.read_fasta(spark, p).collect()}
    assert got == {"c1": ("first", "ACGTAC"), "c2": ("", "GG")}
    tiles = X.tile_sequences(X.read_fasta(spark, p), 4).collect()
    assert {(r["chrom"], r["tile_no"], r["seq"]) for r in tiles} == {("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "GG")}
    assert [r["qual"] for r in X.read_fastq(spark, put("a.fq", "@r x\nAC\n+\nII\n")).collect()] == ["II"]
    gb = put("a.gb", "LOCUS       X1 5 bp\nORIGIN\n        1 acg tt\n//\n")
    assert [(r["name"], r["seq"]) for r in X.read_flat_sequences(spark, gb).collect()] == [("X1", "ACGTT")]
    assert lines(K.as_fasta(X.read_fasta(spark, p).filter("name = 'c2'"))) == [">c2\nGG"]


def test_offsets_tables_autosql(spark, put, tmp_path):
    assert X.read_offsets(put("o.txt", "length\tp_offset\n28\t12\ndefault\t13\n")) == ({28: 12}, 13)
    for bad in ("28\t1\n28\t2\n", "28\n", "28\tx\n"):
        with pytest.raises(ValueError):
            X.read_offsets("", bad)
    K.write_table(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "t"), {"args": "none"})
    assert X.read_table(spark, str(tmp_path / "t")).collect()[0]["y"] == "a"
    name, cols = X.parse_autosql('table t "doc"\n(\nint a; "n"\nint[a] b; "list"\nset(x,y) c; "set"\nweird d; "w"\nint a; "again"\n)')
    assert (name, [(c, t) for c, t, _ in cols]) == ("t", [("a", "int"), ("b", "array<int>"), ("c", "array<string>"), ("d", "string"), ("a2", "int")])
    df = spark.createDataFrame([(["2", "1,2,", "x,y,x", "z", "q"],)], "v array<string>").select(*X.cast_autosql(F.col("v"), cols))
    assert tuple(df.collect()[0]) == (2, [1, 2], ["x", "y"], "z", None)


def test_ucsc(spark, tmp_path):
    B.register(spark)
    w = str(tmp_path / "a.bw")
    items = [("c1", i * 10, i * 10 + 5, float(i)) for i in range(40)] + [("c2", 3, 9, 2.5)]
    B.write_ucsc(w, "bigwig", {"c1": 1000, "c2": 50}, items, per_block=8)
    assert {tuple(r) for r in spark.read.format("bigwig").load(w).collect()} == set(items)
    part = spark.read.format("bigwig").option("chrom", "c1").option("start", 42).option("end", 71).load(w)
    assert {tuple(r) for r in part.collect()} == {x for x in items if x[0] == "c1" and x[1] < 71 and x[2] > 42}
    assert B.ucsc_info(w)["chroms"] == {"c1": 1000, "c2": 50} and B.ucsc_info(w)["summary"]["bases"] == 206
    b = str(tmp_path / "a.bb")
    beds = [("c1", 1, 5, "n1\t0\t+"), ("c1", 7, 9, "n2\t0\t-"), ("c2", 0, 3, "n3\t0\t.")]
    B.write_ucsc(b, "bigbed", {"c1": 1000, "c2": 50}, beds, autosql='table t "d" (string chrom; "c")')
    assert {tuple(r) for r in spark.read.format("bigbed").load(b).collect()} == set(beds)
    assert B.ucsc_info(b)["records"] == 3 and B.ucsc_info(b)["autosql"].startswith("table t")


def test_bigbed_search_and_regions(spark, tmp_path):
    B.register(spark)
    p = str(tmp_path / "s.bb")
    beds = [("c1", i * 10, i * 10 + 15, f"n{i % 7}\t0\t{'+-.'[i % 3]}") for i in range(60)] + [("c2", 3, 9, "n3\t1\t-")]
    sql = 'table t "d" ( string chrom; "c" uint chromStart; "s" uint chromEnd; "e" string name; "n" uint score; "x" char[1] strand; "o" )'
    B.write_ucsc(p, "bigbed", {"c1": 1000, "c2": 50}, beds, per_block=8, autosql=sql, indexed=["name", "score"])
    assert B.ucsc_info(p)["indexed_fields"] == ["name", "score"]
    assert sorted(map(tuple, B.search_bigbed(spark, p, "name", ["n3", "n6", "n3", "none"]).collect())) == sorted(x for x in beds if x[3].split("\t")[0] in ("n3", "n6"))
    assert [tuple(r) for r in B.search_bigbed(spark, p, "score", ["1"]).collect()] == [beds[-1]]
    with pytest.raises(ValueError, match="not indexed"):
        B.search_bigbed(spark, p, "strand", ["+"])
    got = spark.read.format("bigbed").option("regions", '[["c1", 100, 130, "+"], ["c1", 120, 140], ["c2", 0, 4, "+"]]').load(p).collect()
    want = [x for x in beds if x[0] == "c1" and (x[1] < 130 and x[2] > 100 and x[3][-1] in "+." or x[1] < 140 and x[2] > 120)]
    assert sorted(map(tuple, got)) == want and len({tuple(r) for r in got}) == len(got)


def test_track_vectors(spark):
    from strandloom.operators.regions import track_vectors

    runs = spark.createDataFrame([("c", 2, 5, 1.5), ("c", 8, 20, 2.0)], "chrom string, start bigint, end bigint, value double")
    ch = spark.createDataFrame([("a", "c", "-", [(0, 4), (9, 11)]), ("b", "d", "+", [(0, 2)])], f"k string, chrom string, strand string, segments {C.SEGMENTS}")
    got = {r["k"]: r["vector"] for r in track_vectors(runs, ch, "k", -1.0).collect()}
    assert got == {"a": [2.0, 2.0, 1.5, 1.5, -1.0, -1.0], "b": [-1.0, -1.0]}


def bgzf(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, put):
    def read(name, flag, ref, pos, cigar):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(c)) for n, c in cigar)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, 4, -1, -1, 0) + name.encode() + b"\0" + ops + b"\x11\x11" + b"\xff" * 4
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chrA\0" + struct.pack("<i", 99)
    data = head + read("r1", 0, 0, 10, [(5, "M"), (20, "N"), (3, "M"), (2, "D"), (4, "M"), (2, "S")]) + read("r2", 16, 0, 50, [(4, "M"), (1, "I"), (2, "M")]) + read("r3", 4, -1, -1, [])
    rows = {r["read_id"]: r for r in B.read_bam(spark, put("a.bam", bgzf(data[:60]) + bgzf(data[60:]) + bgzf(b""))).collect()}
    assert set(rows) == {"r1", "r2"}
    assert [tuple(x) for x in rows["r1"]["blocks"]] == [(10, 15), (35, 38), (40, 44)] and rows["r1"]["rlen"] == 12
    assert rows["r2"]["strand"] == "-" and [tuple(x) for x in rows["r2"]["blocks"]] == [(50, 56)]


def test_twobit(spark, put):
    seq = "TCAGTNac"
    packed = bytes([0b00011011, 0b00001001])
    rec = struct.pack("<I", 8) + struct.pack("<3I", 1, 5, 1) + struct.pack("<3I", 1, 6, 2) + struct.pack("<I", 0) + packed
    data = struct.pack("<IIII", B.TWOBIT, 0, 1, 0) + b"\x02c1" + struct.pack("<I", 23) + rec
    assert [(r["name"], r["seq"]) for r in B.read_twobit(spark, put("a.2bit", data)).collect()] == [("c1", seq)]


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i int, line string")
    K.write_lines(df, str(tmp_path / "o"), ["i"], "gzip")
    assert sorted(lines(X.text_lines(spark, str(tmp_path / "o")))) == ["a", "b", "c"]
    v = spark.createDataFrame([("r1", [1.0, 2.0])], "region string, vector array<double>")
    K.write_vectors(v, "region", str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).filter("region = 'r1'").count() == 2


def test_records_across_parts(spark, put):
    """Small parts give what one part gives; headers with signs, qualities like headers, lines that are no record."""
    fq = "".join(f"@r{i} x\n{'ACGT'[: 1 + i % 4]}\n+\n{'@III'[: 1 + i % 4]}\n" for i in range(200)) + "stray\n@bad\nAC\n+\nI\n@last\nG\n+\nI\n"
    p = put("a.fq", fq)
    for part in (97, 1 << 20):
        ok, bad = X.read_fastq(spark, p, part=part, rejects=True)
        assert sorted((r["name"], r["seq"]) for r in ok.collect()) == sorted([(f"r{i}", "ACGT"[: 1 + i % 4]) for i in range(200)] + [("last", "G")])
        assert sorted(lines(bad)) == ["+", "@bad", "AC", "I", "stray"]
    wig = "track x\nfixedStep chrom=c start=1 step=3\n" + "".join(f"{i}\n" for i in range(100)) + "variableStep chrom=d span=2\n" + "".join(f"{2 * i + 1} {i}\n" for i in range(100)) + "oops a\n"
    w = put("a.wig", wig)
    want = [("c", 3 * i, 3 * i + 1, float(i)) for i in range(100)] + [("d", 2 * i, 2 * i + 2, float(i)) for i in range(100)]
    for part in (61, 1 << 20):
        ok, bad = X.read_wiggle(spark, w, part=part)
        assert sorted((r["chrom"], r["start"], r["end"], r["value"]) for r in ok.collect()) == want and lines(bad) == ["oops a"]


def test_reader_faults(spark, put):
    fa = put("b.fa", ">s1 map 3->5 end\nAC\nGT\n>s2\nTT\n")
    assert {r["name"]: (r["description"], r["seq"]) for r in X.read_fasta(spark, fa).collect()} == {"s1": ("map 3->5 end", "ACGT"), "s2": ("", "TT")}
    g = put("b.gff", "c\ts\texon\t1\t5\t.\t+\t.\tID=e;Parent=a%2Cb,c\nc s exon 1 5 . + . ID=blank\n##FASTA\n>c\nACGTN\n")
    ok, bad = X.read_gff3(spark, g)
    assert ok.collect()[0]["parents"] == ["a,b", "c"] and lines(bad) == ["c s exon 1 5 . + . ID=blank"]
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.bed", "c\t1\t2\nc\t3\t4\n")
        f.writestr("y.bed", "d\t5\t6\n")
    assert X.read_bed(spark, put("a.zip", z.getvalue()))[0].count() == 3
    b = spark.createDataFrame([(i, q, "c", "+", []) for i, q in enumerate("aabbbaca")], f"i int, query_name string, chrom string, strand string, segments {C.SEGMENTS}")
    assert sorted((r["query_name"], len(r["alignments"])) for r in X.bundle_psl(b, "i").collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 1)]
    assert X.consecutive(b, "query_name", "i", chunk=3).groupBy("run").count().count() == 5 and X.bundle_psl(b).count() == 3


def indexed(records, header, names, magic):
    """(BGZF bytes of records (ref, start, end, bytes), index): a block every few records, bins and least places as the format has them."""
    blob, places, held = b"", [], header
    for n, r in enumerate(records):
        if len(held) > 300:
            blob += bgzf(held)
            held = b""
        places.append((len(blob) << 16 | len(held)))
        held += r[3]
    blob += bgzf(held)
    places.append(len(blob) << 16)
    blob += bgzf(b"")
    out = magic
    for ref in range(len(names)):
        bins, linear = {}, {}
        for (c, a, b, _), v, w in zip(records, places, places[1:]):
            if c != ref:
                continue
            k = next(first + (a >> s) for s, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if a >> s == (b - 1) >> s)
            bins.setdefault(k, []).append((v, w))
            for x in range(a >> 14, ((b - 1) >> 14) + 1):
                linear[x] = min(v, linear.get(x, v))
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *p) for p in c) for k, c in bins.items())
        n = max(linear, default=-1) + 1
        out += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(i, 0)) for i in range(n))
    return blob, out


def test_indexed_bam_and_tabix(spark, put, tmp_path):
    """Several hundred blocks, read in parts and by region."""
    r = __import__("random").Random(2)
    spans_ = sorted((c, a, a + 30 + (5000 if r.random() < 0.1 else 0)) for c in range(2) for a in (r.randrange(400_000) for _ in range(3000)))

    def record(i, c, a, b):
        cigar = [(10, 0), (b - a - 30, 3), (20, 0)] if b - a > 30 else [(30, 0)]
        body = struct.pack("<iiBBHHHiiii", c, a, 7, 30, 0, len(cigar), 0, 0, -1, -1, 0) + f"{i:06d}".encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 1 << 20) for n in (b"c0", b"c1"))
    blob, index = indexed([(c, a, b, record(i, c, a, b)) for i, (c, a, b) in enumerate(spans_)], head, "ab", b"BAI\1" + struct.pack("<i", 2))
    p = put("i.bam", blob)
    plain = {x["read_id"] for x in B.read_bam(spark, p).collect()}
    put("i.bam.bai", index)
    assert len(plain) == len(spans_) and {x["read_id"] for x in B.read_bam(spark, p, part=20_000).collect()} == plain
    lo, hi = 123_456, 131_000
    got = [x["read_id"] for x in B.read_bam(spark, p, "c1", lo, hi).collect()]
    blocks = lambda a, b: [(a, a + 10), (b - 20, b)] if b - a > 30 else [(a, b)]
    want = [f"{i:06d}" for i, (c, a, b) in enumerate(spans_) if c == 1 and any(x < hi and lo < y for x, y in blocks(a, b))]
    assert sorted(got) == want and want and B.read_bam(spark, p, "nowhere").count() == 0

    rows = [(c, a, b, f"c{c}\t{a}\t{b}\tn{i}\n".encode()) for i, (c, a, b) in enumerate(spans_)]
    names = b"c0\0c1\0"
    blob, index = indexed(rows, b"#head\n", "ab", b"TBI\1" + struct.pack("<8i", 2, 0x10000, 1, 2, 3, ord("#"), 0, len(names)) + names)
    t = put("t.bed.gz", blob)
    put("t.bed.gz.tbi", bgzf(index[:60_000]) + (bgzf(index[60_000:]) if index[60_000:] else b"") + bgzf(b""))
    assert read_tabix(spark, t, part=20_000).count() == len(rows)
    regions = [("c0", lo, hi), ("c0", lo + 10, hi + 5000), ("c1", 0, 300), ("zz", 0, 9)]
    got = sorted(x["line"] for x in read_tabix(spark, t, regions).collect())
    assert got == sorted(x.decode().strip() for c, a, b, x in rows if any(f"c{c}" == n and a < e and s < b for n, s, e in regions))
