"""Cleaning goldens, stemmer, tokenizers."""

import pytest
from pyspark.sql import functions as F

from porter_ref import stem as ref_stem

GOLDENS = [
    ("", ""), ("To be or not to be, that is the question", "question"), ("What's up?", ""),
    ("He's so the man", "man"), ("I know the lucky algorithm", "lucki algorithm"), ("`\"*@.,;-_%&/())", ""),
    ("äöü", "aou"), ("I am running in the park", "run park"),
    ("running park parking sun sunny", "run park park sun sunni"), ("greeting", "greet"), ("jumping", "jump"),
    ("programmers", "programm"), ("programers program programming programs", "program program program program"),
    ("coders code coding examples", "coder code code exampl"), ("chocolate is my weakness", "chocol weak"),
    ("HoUsE", "hous"), ("ViLLa", "villa"), ("SEARCH ENGINE", "search engin"), ("42 774423 30954871293857", ""),
    ("l33t", "l33t"), ("blub http://www.google.com/?aowefj=iogreonvr&grej=egroervn bla", "blub bla"),
    ("blub\nbla\nblub", "blub bla blub"), ("blub\tbla\tblub", "blub bla blub"),
]


def test_clean_text_goldens(spark):
    from webloom.functions.cleaning import clean_documents, clean_text
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(GOLDENS)], ["doc_id", "text", "want"])
    rows = df.select("want", clean_text(F.col("text")).alias("got")).collect()
    assert [(r.got, r.want) for r in rows if r.got != r.want] == []
    job = {r.doc_id: r.text for r in clean_documents(df.select("doc_id", "text")).collect()}
    assert {str(i): b for i, (_, b) in enumerate(GOLDENS)} == job


WORDS = ("caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping "
         "tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci "
         "digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator "
         "feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative "
         "formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic "
         "adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate "
         "angulariti homologous effective bowdlerize probate rate cease controll roll yyy ayy syzygy boyyed a an "
         "ion lion station ies eed feeds é café l33t").split()


def test_porter_matches_sequential_reference(spark):
    from webloom.functions.stem import stem
    rows = spark.createDataFrame([(w,) for w in WORDS], ["w"]).select("w", stem(F.col("w")).alias("s")).collect()
    assert [(r.w, r.s, ref_stem(r.w)) for r in rows if r.s != ref_stem(r.w)] == []
    got = {r.w: r.s for r in rows}
    assert got["caresses"] == "caress" and got["ponies"] == "poni" and got["relational"] == "relat"
    assert got["hopping"] == "hop" and got["filing"] == "file" and got["happy"] == "happi"


def test_porter_on_corpus_words(spark):
    from webloom.functions.stem import stem
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}']+"), 0)).alias("w"))
    rows = words.distinct().select("w", stem(F.col("w")).alias("s")).collect()
    assert len(rows) > 1000
    assert [r.w for r in rows if r.s != ref_stem(r.w)] == []


def test_stems_in_arrow_batches_are_those_of_the_expression(spark):
    from webloom.functions.stem import porter, stem_expression, stem_tokens
    rows = [(0, WORDS), (1, []), (2, None), (3, ["running", None, "running"]), (4, [""])]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        (F.col("doc_id") + 10).alias("i"), F.split(F.lower("text"), "[^a-zé]+").alias("t"))
    df = spark.createDataFrame(rows, "i int, t array<string>").unionByName(docs).repartition(3)
    bad = df.select("t", stem_tokens("t").alias("a"), stem_expression(F.col("t")).alias("b")).filter("NOT (a <=> b) AND i <> 3")
    assert bad.count() == 0
    got = {r.i: r.a for r in df.filter("i < 10").select("i", stem_tokens("t").alias("a")).collect()}
    assert got[1] == [] and got[2] is None and got[3] == ["run", None, "run"] and got[4] == [""]
    assert [w for w in WORDS if porter(w) != ref_stem(w)] == []


@pytest.mark.parametrize("line,want", [
    ("a b  c", ["a", "b", "", "c"]), ("a b  ", ["a", "b"]), ("   ", []), ("", [""]), (" a", ["", "a"])])
def test_space_tokens_java_split(spark, line, want):
    from webloom.functions.tokens import space_tokens
    got = spark.createDataFrame([(line,)], ["l"]).select(space_tokens(F.col("l")).alias("t")).first().t
    assert got == want


@pytest.mark.parametrize("text,want", [
    ("a&b", ["a", "&", "b"]), ("don't stop.", ["don't", "stop."]), ("x «y» z", ["x", "«", "y", "»", "z"]),
    ("l33t (ok)", ["l33t", "(ok)"]), ("  ", [])])
def test_block_tokens(spark, text, want):
    from webloom.functions.tokens import block_tokens
    got = spark.createDataFrame([(text,)], ["s"]).select(
        F.filter(block_tokens(F.col("s")), lambda t: t != "").alias("t")).first().t
    assert got == want


def test_entities_and_fold(spark):
    from webloom.functions.entities import decode_entities
    from webloom.functions.fold import ascii_fold
    r = spark.createDataFrame([("a &amp; b &lt;p&gt; &#233; &#x20AC; &copy; &bogus;", "Ærø ﬁne ½ café")],
                              ["e", "f"]).select(decode_entities(F.col("e")).alias("e"),
                                                 ascii_fold(F.col("f")).alias("f")).first()
    assert r.e == "a & b <p> é € © &bogus;"
    assert r.f == "r fine 12 cafe"


def test_long_words_pass_the_analyzer(spark):
    from webloom.functions.cleaning import analyze, analyzer_tokens, clean_text
    word = "ab" * 500_000
    df = spark.createDataFrame([(word + " can't 3.14 a.b. x:y 1:2",)], "text string")
    got = df.select(F.size(analyze(F.col("text"))).alias("n"), F.length(clean_text(F.col("text"))).alias("m"),
                    F.slice(analyzer_tokens(F.col("text")), 2, 9).alias("rest")).first()
    assert got.n >= 1 and got.m >= 1_000_000
    assert got.rest == ["can't", "3.14", "a.b", "x:y", "1", "2"]


def test_cleaning_a_corpus_is_one_scan_without_exchange(spark):
    from paths import SF001
    from webloom.functions.cleaning import clean_documents
    plan = clean_documents(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_spared_patterns_are_the_plain_ones(spark):
    """The patterns' look-aheads and listed classes change no result; texts without "://" have no URL."""
    from webloom.functions import cleaning as C
    loose = r"(?!(?<=[\p{L}\p{M}])['.:’‘·]\p{L}|(?<=\p{Nd})[.,;'’‘]\p{Nd})['.:’‘·,;]"
    ideo = r"\p{IsHan}\p{IsHiragana}"
    token = "[" + ideo + r"]|[\p{L}\p{M}\p{Nd}_'.:’‘·,;&&[^" + ideo + "]]++"
    texts = ["", "can't. O’Neil's 3.14,5 a.b.c x:y 1;2 l·l", "漢字かなカナabc漢x_1é9ü ...  ' _ ·", "a1b 22 c333d x4 5\t66\n7,8 é9é", "http://a.b/c?d x ftp:/no :// End."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all(F.regexp_replace("t", loose, " "), F.lit(token), 0)
    url = r"(?i)\b(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]"
    for r in rows.select("t", C.all_tokens(F.col("t")).alias("a"), plain.alias("b"), C.remove_numbers(F.col("t")).alias("c"),
                         F.regexp_replace("t", "[^a-zA-Z][0-9]+[^a-zA-Z]", "").alias("d"), C.remove_urls(F.col("t")).alias("e"),
                         F.regexp_replace("t", url, "").alias("f")).collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r.t
