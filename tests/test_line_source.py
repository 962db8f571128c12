"""The line source: every cut gives the lines that Spark's own scan gives, in order and without a copy."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.plans import catalog
from blockloom.sources import line_source as S
from blockloom.sources import readers as R


def plain(data: bytes) -> list[bytes]:
    if data.startswith(S.BOM):
        data = data[3:]
        if not data:
            return [b""]
    lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    return lines[:-1] if not lines[-1] else lines


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_any_cut_gives_the_same_lines(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    cases = [b"", b"\n", b"\r", b"\r\n", b"a", b"a\r\nb\r\rc\n\n", b"\xef\xbb\xbfx\ny", b"\r\n" * 9, b"\n\r" * 5 + b"z"]
    cases += [bytes(rng.choices(b"ab\n\r\xc3", k=rng.randint(1, 40))) for _ in range(60)]
    for i, data in enumerate(cases):
        path = tmp_path / f"{chunk}-{i}.txt"
        path.write_bytes(data)
        for cut in (1, 2, 3, 5, 100):
            got, places = [], []
            for start in range(0, len(data), cut):
                found = list(S.lines_in(str(path), start, min(start + cut, len(data))))
                lines = [(d[f : f + n].tobytes(), o + int(f)) for d, first, size, o in found for f, n in zip(first, size)]
                assert len(lines) == S.count_lines(str(path), start, min(start + cut, len(data)))
                got += [x for x, _ in lines]
                places += [o for _, o in lines]
            assert got == plain(data), (data, cut)
            assert all(data[o : o + len(x)] == x for x, o in zip(got, places))


def test_ranges_do_not_depend_on_the_session(spark, tmp_path):
    text = "".join(f"line {i} é{'x' * (i % 50)}\n" for i in range(5000))
    (tmp_path / "b.txt").write_text(text)
    (tmp_path / "a.txt").write_text("first\n\nthird")
    (tmp_path / "c.txt").write_text("")
    want = ["first", "", "third", *text.splitlines()]
    for size in (500, 7000, 1 << 20):
        rows = R.read_lines(spark, str(tmp_path), range_bytes=size).orderBy("row_idx").collect()
        assert [r["row_idx"] for r in rows] == list(range(len(want)))
        assert [r["text"] for r in rows] == want
    assert R.read_lines(spark, str(tmp_path), range_bytes=500).rdd.getNumPartitions() > 1
    files = S.list_files(spark, str(tmp_path))
    for r in S.read_ranges(spark, files, 900, places=True).filter(F.col("row_idx") % 500 == 3).collect():
        with open(r["file"].replace("file:", ""), "rb") as f:
            f.seek(r["offset"])
            assert f.readline().decode().rstrip("\n") == r["text"] == want[r["row_idx"]]


def test_no_copy_of_the_text_is_made(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "stored", lambda *a: pytest.fail("the text was copied"))
    (tmp_path / "a.txt").write_text("x\ny\n")
    plan = R.read_lines(spark, str(tmp_path / "a.txt"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    assert catalog.src_text_files(spark, sf).count() > 0


def test_files_it_cannot_open_go_through_sparks_scan(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("one\n\ntwo\n")
    rows = R.read_lines(spark, str(tmp_path / "a.txt.gz")).orderBy("row_idx").collect()
    assert [r["text"] for r in rows] == ["one", "", "two"]
    assert not S.can_open("nostore://x/y") and not S.can_open(str(tmp_path / "none"))
