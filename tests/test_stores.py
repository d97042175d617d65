"""Archives read by ranges of entries, and files written with a commit."""

import os
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltworks.operators import organize
from siltworks.sources import stores


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    rnd = random.Random(3)
    big = rnd.randbytes(9 << 20)
    with zipfile.ZipFile(folder / "a.apk", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("classes.dex", b"dex"), ("classes2.dex", b""), ("lib/x86/a/l.so", b"one"), ("lib/x86/b/l.so", b"two"), ("assets/", b""), ("assets/é b.bin", big), ("res/raw/n.xml", b"<n/>"), ("META-INF/x", b"no"), ("../evil", b"no"), ("/evil", b"no")):
            z.writestr(name, data)
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        for i in range(40):
            z.writestr(f"assets/{i}", rnd.randbytes(1 << 16))
    with zipfile.ZipFile(folder / "empty.zip", "w"):
        pass
    return folder, big


def load(spark, path, **options):
    stores.register(spark)
    return spark.read.format("archive").options(**options).load(str(path))


def test_names_without_contents(spark, archives):
    rows = load(spark, archives[0], pattern="*.apk").orderBy("entry_no").collect()
    assert [(r.entry_name, r.is_dir, r["size"]) for r in rows][:6] == [("classes.dex", False, 3), ("classes2.dex", False, 0), ("lib/x86/a/l.so", False, 3), ("lib/x86/b/l.so", False, 3), ("assets/", True, 0), ("assets/é b.bin", False, 9 << 20)]
    assert all(r.content is None for r in rows) and not any("evil" in r.entry_name for r in rows)


def test_contents_come_in_pieces_of_bounded_size(spark, archives):
    folder, big = archives
    rows = load(spark, folder / "a.apk", content="true").filter(F.col("entry_name") == "assets/é b.bin").orderBy("piece").collect()
    assert [len(r.content) for r in rows] == [4 << 20, 4 << 20, 1 << 20] and b"".join(r.content for r in rows) == big
    assert [r.content for r in load(spark, folder / "a.apk", content="true").filter("entry_name = 'classes2.dex'").collect()] == [b""]


def test_a_large_archive_is_split_by_its_entries(spark, archives):
    whole, split = (load(spark, archives[0] / "b.zip", content="true", split=s) for s in (1 << 30, 5 << 16))
    assert (whole.rdd.getNumPartitions(), split.rdd.getNumPartitions()) == (1, 8)
    digest = lambda df: sorted(map(tuple, df.select("entry_no", "entry_name", F.sha2("content", 256)).collect()))
    assert digest(split) == digest(whole) and len(digest(whole)) == 40


def test_filters_reach_the_source(archives):
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    reader = stores.ArchiveReader({"path": str(archives[0]), "content": "true", "split": "1"})
    assert list(reader.pushFilters([EqualTo(("piece",), 0), In(("entry_name",), ("classes.dex", "x")), EqualTo(("entry_name",), "classes.dex"), StringStartsWith(("entry_name",), "c")])) == [EqualTo(("piece",), 0)]
    parts = reader.partitions()
    assert len(parts) == 3 and all(p.names == ["classes.dex"] and p.prefix == "c" for p in parts)
    assert [r.column(2).to_pylist() for p in parts for r in reader.read(p)] == [["classes.dex"]]


def test_a_broken_archive(spark, archives, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a", b"1")
    raw = bytearray((tmp_path / "good.zip").read_bytes())
    raw[31] ^= 255  # the one byte of content: its CRC no longer holds
    (tmp_path / "crc.zip").write_bytes(raw)
    with pytest.raises(PySparkException):
        load(spark, tmp_path, content="true").collect()
    got = {os.path.basename(r.archive): (r.entry_name, r.error) for r in load(spark, tmp_path, content="true", mode="permissive").collect()}
    assert got["good.zip"] == ("a", None) and got["bad.zip"][1].startswith("BadZipFile") and got["crc.zip"][1].startswith("BadZipFile")
    with pytest.raises(PySparkException):
        load(spark, tmp_path / "nowhere").collect()
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").count() == 0


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_extraction_routes_entries_and_later_ones_replace_earlier(spark, archives, tmp_path):
    folder, big = archives
    entries = load(spark, folder / "a.apk", content="true")
    names = organize.extracted(load(spark, folder / "a.apk"))
    organize.write_files(organize.last_of_each(organize.extracted(entries), names), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"dex/classes.dex": b"dex", "dex/classes2.dex": b"", "native/x86/l.so": b"two", "assets/é b.bin": big, "res/raw/n.xml": b"<n/>"}
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_files_are_there_only_after_the_commit(spark, tmp_path):
    out = str(tmp_path / "p" / "out")
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}", f"text é {i}") for i in range(50)] + [("top", None)], "path string, content string").repartition(5)
    organize.write_files(rows, out)
    assert len(tree(out)) == 51 and tree(out)["d1/f4"] == "text é 4".encode() and tree(out)["top"] == b""
    organize.write_files(spark.createDataFrame([("top", b"\x00new"), ("more/x", b"1")], "path string, content binary"), out)
    assert len(tree(out)) == 52 and tree(out)["top"] == b"\x00new"
    organize.write_files(spark.createDataFrame([("only", "1")], "path string, content string"), out, "overwrite")
    assert tree(out) == {"only": b"1"}

    bad = rows.withColumn("path", F.when(F.col("path") == "d2/f5", "../x").otherwise(F.col("path")))
    with pytest.raises(ValueError):
        organize.write_files(bad, out)
    assert tree(out) == {"only": b"1"} and os.listdir(tmp_path / "p") == ["out"]
    organize.write_files(rows.limit(0), str(tmp_path / "p" / "none"))
    assert tree(tmp_path / "p" / "none") == {}


def test_an_attempt_that_dies_leaves_nothing_in_the_tree(tmp_path):
    from pyspark.sql import Row

    def rows(n):
        for i in range(5):
            if i == n:
                raise OSError("lost")
            yield Row(path=f"f{i}", content="x" * i)

    writer = stores.FileWriter(str(tmp_path / "out"), "job", False, ["path", "content"])
    with pytest.raises(OSError):
        writer.write(rows(3))
    done = writer.write(rows(9))  # the same task once more
    writer.commit([done])
    assert tree(tmp_path / "out") == {f"f{i}": b"x" * i for i in range(5)} and (done.files, done.bytes) == (5, 10)
    assert os.listdir(tmp_path) == ["out"]


def test_pieces_are_one_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1", 0), ("a", b"2", 1), ("b", b"3", 0)], "path string, content binary, piece int").coalesce(1)
    organize.write_files(rows, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"a": b"12", "b": b"3"}


def test_very_many_ranges_are_dealt_to_a_bounded_number_of_tasks(tmp_path, monkeypatch):
    """Every entry is read once, in order, and a broken archive costs only its own rows."""
    for i in range(60):
        with zipfile.ZipFile(tmp_path / f"a{i:02}.zip", "w") as z:
            for k in range(8):
                z.writestr(f"e{k}", os.urandom(1000 * (i % 5 + 1)))
    (tmp_path / "a30x.zip").write_bytes(b"PK no archive")
    monkeypatch.setattr(stores, "TASKS", 10)
    for content in ("true", "false"):
        reader = stores.ArchiveReader({"path": str(tmp_path), "content": content, "split": "1", "mode": "PERMISSIVE"})
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert len(parts) <= 10 and [(os.path.basename(r["archive"]), r["entry_name"]) for r in rows if not r["error"]] == [(f"a{i:02}.zip", f"e{k}") for i in range(60) for k in range(8)]
        assert [os.path.basename(r["archive"]) for r in rows if r["error"]] == ["a30x.zip"]
        assert content == "false" or all(len(r["content"]) == r["size"] for r in rows if not r["error"])
