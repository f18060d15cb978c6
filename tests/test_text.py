import pytest
from pyspark.sql import functions as F

from gradeframe.functions import files, stopwords, text

X = F.col("x")


@pytest.mark.parametrize("given, wanted", [
    ("foo\nbar", ["foobar"]),               # a line break is deleted, so words fuse
    ("foo\tbar baz", ["foobar", "baz"]),
    ("Don't go", ["dont", "go"]),            # the apostrophe goes before the stopword test
    ("it's here", []),
    ("café 42 x", ["caf", "x"]),
    ("  ", []),
    ("b a b", ["b"]),
])
def test_keyword_terms(one, given, wanted):
    assert one(text.keyword_terms(X, stopwords.BASE), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("don't stop", ["stop"]),                # don is no stopword here only because of its own list
    ("café123 5", ["caf", "123"]),
    ("naïve", ["nave"]),
    ("a1b22", ["22"]),
    ("x_y zz--zz", ["zz", "zz"]),
    ("日本 ab", ["ab"]),
    ("1é23", ["23"]),
    ("", []),
])
def test_clean_tokens(one, given, wanted):
    tokens = one(text.clean_tokens(X, [*stopwords.BASE, "don"]), x=given)
    assert tokens == wanted


def test_supplementary_letters_separate(one):
    assert one(text.clean_tokens(X, []), x="ab\U0001d54fcd 12\U0001d7d834") == ["ab", "cd", "12", "34"]


def test_null_text_stays_null(one):
    assert one(text.clean_tokens(X, []), x=None) is None
    assert one(text.keyword_terms(X, []), x=None) is None


def test_stopword_list():
    assert len(stopwords.BASE) == len(set(stopwords.BASE)) == 172
    assert {"no", "nor", "not"} <= set(stopwords.BASE)


def test_list_from_files(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("Alpha\n beta \n\n")
    read = stopwords.read_stopwords(spark, str(tmp_path / "mine.txt"), "mine")
    assert sorted(map(tuple, read.collect())) == [("mine", "alpha"), ("mine", "beta")]
    table = str(tmp_path / "lists.parquet")
    read.unionByName(read.selectExpr("'other' AS list_name", "'gamma' AS word")).write.parquet(table)
    assert {r.word for r in stopwords.read_stopwords(spark, table, "other").collect()} == {"gamma"}


def test_drop_stopwords_keeps_repeats(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b")], "id int, term string")
    words = spark.createDataFrame([("a",), ("a",)], "word string")
    assert sorted(map(tuple, text_rows(stopwords.drop_stopwords(terms, words)))) == [(1, "b"), (2, "b"), (2, "b")]


def text_rows(frame):
    return frame.select("id", "term").collect()


@pytest.mark.parametrize("given, control, unicode", [
    ("\x00\x01 a b\r\n", "a b", "\x00\x01 a b"),
    (" a ", " a ", "a"),
    (" a", " a", " a"),       # a no-break space is kept by both
    ("a\n\n", "a", "a"),
])
def test_trims(one, given, control, unicode):
    assert one(text.trim_control(X), x=given) == control
    assert one(text.strip_unicode(X), x=given) == unicode


@pytest.mark.parametrize("given, wanted", [
    ("```json\n{\"a\":1}\n```", '{"a":1}'),
    ("```\n[1]```", "[1]"),
    ("```JSON [1]", "[1]"),
    ("a ```b```", "a ```b```"),
    ("```x```y```", "```y"),
])
def test_fence(one, given, wanted):
    assert one(text.strip_fence(X), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("a\nb", ["a", "b"]), ("a\n\nb\n\n\n", ["a", "", "b"]), ("a", ["a"]), ("\na", ["", "a"]),
])
def test_reason_lines(one, given, wanted):
    assert one(text.reason_lines(X), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [
    (b"%PDF-1.4", "pdf"), (b"PK\x03\x04", "docx"), (b"PK", "docx"), (b"%PD", "txt"), (b"", "txt"), (b"P", "txt"),
])
def test_document_type(one, given, wanted):
    assert one(files.document_type(X), x=given) == wanted


def test_document_text(one):
    assert one(files.document_text(X), x=" \n grün\t".encode()) == "grün"
    broken = one(files.document_text(X), x=b"ab\xff\xfecd")
    assert broken.startswith("ab") and broken.endswith("cd") and "�" in broken


@pytest.mark.parametrize("given, wanted", [
    ("a.png", "image/png"), ("A.PNG", "image/png"), ("a.gif", "image/gif"), ("a.webp", "image/webp"),
    ("a.jpg", "image/jpeg"), ("png", "image/jpeg"), ("x.bmp", "image/jpeg"),
])
def test_media_type(one, given, wanted):
    assert one(files.media_type(X), x=given) == wanted


def test_data_url_is_one_line(one):
    import base64
    raw = bytes(range(256)) * 3
    url = one(files.data_url(F.lit("image/png"), X), x=raw)
    assert url == "data:image/png;base64," + base64.b64encode(raw).decode()
