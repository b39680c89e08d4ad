"""Files of each kind written and read back; partitions, damage, order."""

import pytest

from tidemark.sources import office
from tidemark.sources.officewriter import FORMATS, file_of, zipped


@pytest.mark.parametrize("kind", FORMATS)
def test_titles_and_lines_come_back(kind):
    got = [(b[0], b[1], b[5]) for b in office.blocks_of(f"x.{kind}", file_of(kind, "A & <B>", ["one é", "two | 2"]))]
    want = {
        "docx": [("heading", 1, "A & <B>"), ("text", None, "one é"), ("text", None, "two | 2")],
        "pptx": [("heading", 1, "A & <B>"), ("text", None, "one é\ntwo | 2")],
        "xlsx": [("table", None, "[Sheet: Head]\nA & <B>"), ("table", None, "[Sheet: Body]\none é\t1\ntwo | 2\t2")],
        "odt": [("text", None, "A & <B> one é two | 2")],
    }
    want["epub"] = want["docx"]
    assert got == want.get(kind, [("code", None, "# A & <B>\none é\ntwo | 2")] if kind == "py" else [("text", None, "A & <B>\none é\ntwo | 2")])


def test_a_book_without_a_spine_goes_by_its_archive():
    pages = {"b.xhtml": "<p>first</p>", "a.html": "<p>second</p>", "note.txt": "no"}
    assert [b[5] for b in office.blocks_of("x.epub", zipped(pages))] == ["first", "second"]


def test_partitions_and_errors(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k:02d}.txt").write_text("x" * 1000)
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "picture.png").write_bytes(b"no")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "bad.docx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "below" / "empty.csv").write_bytes(b"")
    (tmp_path / "below" / "latin.csv").write_bytes(b"a,\xe9")
    df = office.read_documents(spark, str(tmp_path), 3000)
    assert df.rdd.getNumPartitions() >= 7
    rows = {r["path"].rpartition("/")[2]: r for r in df.collect()}
    assert len(rows) == 22 and rows["bad.docx"]["text"] is None and rows["bad.docx"]["error"].startswith("BadZipFile")
    assert rows["latin.csv"]["text"] == "a,�" and rows["00.txt"]["error"] is None
    assert office.read_documents(spark, str(tmp_path / "nothing")).count() == 0
