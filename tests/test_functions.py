from pyspark.sql import functions as F

from schedlake.functions import dates, numbers, text


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr).first()[0]


def test_numbers(spark):
    good = ["1", " -1.5 ", "+.5", "5.", "1e3", "1E-3"]
    bad = ["", " ", "1d", "NaN", "Infinity", "0x10", "1,5", "1.2.3", "1e", "--", "8 0", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    got = [r[0] for r in df.select(numbers.to_number(F.col("t"))).collect()]
    assert got == [1.0, -1.5, 0.5, 5.0, 1000.0, 0.001] + [None] * len(bad)


def test_halves_round_up(spark):
    df = spark.createDataFrame([(-0.25,), (0.25,), (2.45,)], "x double")
    assert [r[0] for r in df.select(numbers.round_half_up(F.col("x"), 1)).collect()][:2] == [-0.2, 0.3]
    shares = spark.createDataFrame([(1, 3), (0, 0), (2, 2)], "a int, b int").select(numbers.percent(F.col("a"), F.col("b")))
    assert [r[0] for r in shares.collect()] == [33.3, 0.0, 100.0]


def test_real_dates(spark):
    good = ["2024-02-29", "2025-01-01 23:59"]
    bad = ["2025-02-29", "2025-13-01 08:00", "0000-01-01", "2025-01-01 24:00", "2025-01-01T08:00", "31/04/2025", "2025-1-1", "", "2025-01-01\n"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    assert [r[0] for r in df.select(dates.is_real_date(F.col("t"))).collect()] == [True] * 2 + [False] * len(bad)
    assert one(spark, dates.minute_number(F.col("t")), t="1970-01-02 01:30") == 1440 + 90
    assert one(spark, dates.minute_number(F.col("t")), t="1970-01-02") == 1440


def test_cp1252_decodes_every_byte(spark):
    data = bytes(range(256))
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    want = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)
    assert df.select(text.decode_cp1252(F.col("b"))).first()[0] == want
    facts = df.select(*[c.alias(n) for n, c in text.decode_report(F.decode("b", "iso-8859-1")).items()]).first()
    assert facts["undefined_byte_count"] == 5 and facts["high_byte_count"] == 128
    run = spark.createDataFrame([(bytearray("é–😀".encode() + b"\xc3("),)], "b binary")
    assert run.select(text.decode_report(F.decode("b", "iso-8859-1"))["utf8_sequence_count"]).first()[0] == 3


def test_search_subset(spark):
    words = F.split(F.lit("the north quay wall schedule"), " ")
    for query, want in {
        "quay": True, "quay wall": True, '"wall quay"': False, '"quay wall"': True, "-quay": False, "depot or quay": True, "depot quay": False, "": True,
        "or": True, "-depot wall": True,
    }.items():
        assert spark.range(1).select(text.search_match(words, query)).first()[0] is want, query


def test_text_parts(spark):
    assert one(spark, text.slugify(F.col("t")), t="  Père's “Quay” – Nº 5!  ") == "peres-quay-n-5"
    assert one(spark, text.slugify(F.col("t")), t="???") == "programme"
    assert one(spark, text.canonical_list(F.col("t")), t="Rail, marine,rail,,") == ["marine", "rail"]
    same = text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))
    assert one(spark, same, a="Depot", b="depot") == 1.0
    assert one(spark, same, a="", b="") == 0.0
