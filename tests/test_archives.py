"""Archives read where they lie: several at once, JSON and JSON lines, damage."""

import gzip
import io
import json
import tarfile

import pytest

from scriptorium.sources import archives


def pack(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        folder = tarfile.TarInfo("folder.json")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


@pytest.fixture
def folder(tmp_path):
    for k in range(4):
        lines = "".join(json.dumps({"id": f"{k}-{i}", "text": "é" * i}) + "\n\n" for i in range(50)).encode()
        papers = json.dumps({f"p{k}{i}": {"title": f"T{i}"} for i in range(3)}).encode()
        pack(tmp_path / f"a{k}.tar.gz", {f"set/claims-{k}.jsonl": lines, f"set/papers-{k}.json": papers, "set/readme.txt": b"no", "set/none.jsonl": b""})
    pack(tmp_path / "empty.tgz", {})
    (tmp_path / "other.zip").write_bytes(b"not an archive")
    return tmp_path


@pytest.mark.parametrize("form", ["{}", "{}/*", "file://{}"])
def test_archives_in_parallel(spark, folder, form):
    rows = archives.read_archives(spark, form.format(folder))
    assert rows.rdd.getNumPartitions() == 5
    claims = archives.json_values(rows.where("member LIKE '%.jsonl'"), "id string, text string")
    got = sorted((r.archive, r.line, r.value.id, len(r.value.text)) for r in claims.collect())
    assert got == sorted((f"a{k}.tar.gz", i, f"{k}-{i}", i) for k in range(4) for i in range(50))
    papers = archives.keyed_papers(rows.where("member LIKE '%.json'"), "struct<title:string>")
    assert sorted((r.id, r.entry.title) for r in papers.collect()) == sorted((f"p{k}{i}", f"T{i}") for k in range(4) for i in range(3))


def test_suffixes_and_single_files(spark, folder):
    rows = archives.read_archives(spark, str(folder / "a1.tar.gz"), suffixes="papers-1.json")
    assert [(r.member, r.line) for r in rows.collect()] == [("set/papers-1.json", 0)]
    assert archives.read_archives(spark, str(folder / "empty.tgz")).count() == 0
    (folder / "bare").mkdir()
    assert archives.read_archives(spark, str(folder / "bare")).count() == 0
    with pytest.raises(Exception, match="missing.tar.gz"):
        archives.read_archives(spark, str(folder / "missing.tar.gz")).count()


@pytest.mark.parametrize("damage", ["cut", "no archive", "not text"])
def test_damage(spark, folder, damage):
    bad = folder / "bad.tar.gz"
    if damage == "not text":
        pack(bad, {"x.jsonl": b'{"id": "x"}\n\xff\xfe\n'})
    else:
        whole = (folder / "a0.tar.gz").read_bytes()
        bad.write_bytes(whole[: len(whole) // 2] if damage == "cut" else gzip.compress(b"plain text, no archive" * 100))
    with pytest.raises(Exception, match="bad.tar.gz"):
        archives.read_archives(spark, str(folder)).count()
    rows = archives.read_archives(spark, str(folder), permissive=True)
    assert rows.where("problem IS NULL AND archive <> 'bad.tar.gz'").count() == 4 * 51
    assert [r.archive for r in rows.where("problem IS NOT NULL").collect()] == ["bad.tar.gz"]
