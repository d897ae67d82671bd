from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions import text as T


def test_clean_text_splits_at_every_line_break(values):
    assert values(T.clean_text, [" a \r\n\r\n b\x0bc d\x85 ", "", None]) == ["a\nb\nc\nd", "", None]


def test_clean_ocr_text_drops_short_lines(values):
    assert values(T.clean_ocr_text, ["abc\n ab \n\txyz\t", None]) == ["abc\nxyz", ""]


def test_sanitize(values):
    long = "x" * 9000
    out = values(T.sanitize_text, ["a\x00b\r\nc\rd", "a\n\n\n\n\n  b   c\t\t\n\t\n", long, None, "x" * 8000])
    assert out[0] == "ab\nc\nd"
    assert out[1] == "a\nb c"
    assert out[2] == "x" * 8000 + K.TRUNCATION_MARKER
    assert out[3] == ""
    assert out[4] == "x" * 8000


def test_input_problem(values):
    out = values(T.input_problem, [None, "", "short", " " * 20, '  {"a": 1, "b": 2}', '"quoted text here"', "A proper text"])
    assert out == [
        "Invalid text input: <class 'NoneType'>", "Invalid text input: <class 'str'>", "Text too short or empty",
        "Text too short or empty", "Text appears to be JSON, not document content",
        "Text appears to be JSON, not document content", None]


def test_fix_word_spacing(values):
    out = values(T.fix_word_spacing, ["thisIs aTest", "from2020to2021", "MrSmith", "Dr.Who", " a  \t b ", "ABTechnologies"])
    assert out == ["this Is a Test", "from 2020 to 2021", "Mr Smith", "Dr Who", "a b", "AB Technologies"]


def test_language(values):
    out = values(T.detect_language, ["Työ", "Todistus on", "plain text", "", None, "VÄLISENÄ"])
    assert out == ["fin", "fin", "eng", "auto", "auto", "fin"]
    assert "[äöå]|todistus|" in T._language_pattern(K.WORKFLOW_KEYWORDS)


def test_diacritics_and_confidence(spark, values):
    assert values(T.diacritic_count, ["ÄäÖöÅå e", "none", ""]) == [6, 0, 0]
    frame = spark.createDataFrame(
        [("pdf", "fin"), (".PNG", "eng"), (".docx", "auto"), ("png", "auto")], "s string, l string")
    got = [round(r.v, 4) for r in frame.select(T.text_confidence(F.col("s"), F.col("l")).alias("v")).collect()]
    assert got == [0.95, 0.85, 0.85, 0.8]
    off = frame.select(T.text_confidence(F.col("s"), F.col("l"), finnish_detection=False).alias("v")).first().v
    assert round(off, 4) == 0.85


def test_bands_suffix_media(values):
    assert values(T.confidence_band, [80.0, 79.9, 50.0, 49.9, None], "double") == ["high", "medium", "medium", "low", None]
    assert values(T.suffix_of, ["a.PDF", "b.tar.gz", "none", ".profile", "dir.x/file", None]) == [
        "pdf", "gz", "", "", "", None]
    assert values(T.media_type, ["pdf", "JPG", "doc", "bmp"]) == [
        K.MEDIA_TYPES["pdf"], "image/jpeg", K.MEDIA_TYPES["docx"], K.DEFAULT_MEDIA_TYPE]


def test_template(values):
    build = lambda x: T.render_template("{{a}} {x}-{x} {y}", {"x": x, "y": F.lit(None)}, "none")
    assert values(build, ["q", None]) == ["{a} q-q none", "{a} none-none none"]
