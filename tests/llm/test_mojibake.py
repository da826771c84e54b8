import random

import numpy as np
import pandas as pd
import pytest

from schedlake.llm import mojibake

CLEAN = [
    "Réception du bâtiment côté quai", "Étanchéité de la façade", "INSPEÇÃO DA ESTAÇÃO", "Fundação das vigas três", "Prüfung Schlüsselkasten Höhe", "Montaż słupów część północna",
    "Проверка кабельной линии", "Survey 10 m³ sump", "Test 90° bends – Stage 3", "client’s spares", "Pour tank roof", "Erect ½ inch drain line",
]
GARBLES = [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp850", "cp1252")]


def garble(text, true, read):
    return mojibake._encode(text, true).decode(read, "strict") if read != "cp1252" else "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(true))


def cases():
    for text in CLEAN:
        for true, read in GARBLES:
            try:
                bad = garble(text, true, read)
            except (UnicodeError, TypeError):
                continue
            if bad != text and not text.isascii():
                yield text, bad


def fitted(names):
    copies = pd.Series(names).value_counts()
    counted = next(mojibake._count_pairs(iter([pd.DataFrame({"text": copies.index, "weight": np.log2(1 + copies.to_numpy())})])))
    return mojibake.PairModel(counted["pair"].to_numpy(), counted["n"].to_numpy())


@pytest.fixture(scope="module")
def model():
    names = [f"{t} {i}" for t in CLEAN for i in range(300)] + [bad for _, bad in cases()]
    return fitted(names)


def test_garbled_texts_come_back(model):
    fix = mojibake.Restorer(model)
    got = [(good, bad, fix(bad)) for good, bad in cases()]
    assert len(got) > 30
    assert all(g for _, _, (g, _) in got), [b for _, b, (g, _) in got if not g]
    assert sum(r == good for good, _, (_, r) in got) >= 0.97 * len(got), [(b, r) for good, b, (_, r) in got if r != good]


def test_clean_texts_stay(model):
    fix = mojibake.Restorer(model)
    assert [t for t in CLEAN if fix(t)[0]] == []
    assert not fix("Zone B – east – 90°")[0]


def test_stacked_partial_and_lost(model):
    fix = mojibake.Restorer(model)
    twice = garble(garble("Réception du bâtiment", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert fix(twice) == (True, "Réception du bâtiment")
    assert fix(garble("Réception", "utf-8", "cp1252") + " du bâtiment")[1] == "Réception du bâtiment"
    assert fix("R�ception du bâtiment") == (True, None)


def test_segments_match_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        score = [rnd.randrange(-5, 6) for _ in range(rnd.randrange(1, 14))]
        got = mojibake.maximal_segments(score)
        best = max(sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1))
        assert (max(sum(score[a:b]) for a, b in got) if got else 0) == max(best, 0)
        assert all(a < b <= c for (a, b), (c, _) in zip(got, got[1:], strict=False)) and all(sum(score[a:b]) > 0 for a, b in got)


def test_counts_cover_all_rows(spark):
    rows = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("é" * 100_000,), ("𐍈",), ("a\ufffdb",)], "text string")
    counts = {r["pair"]: r["n"] for r in mojibake.pair_counts(rows).collect()}
    a, b, e = (int(mojibake._CODE[ord(c)]) for c in "abé")
    n = len(mojibake.ALPHABET)
    # Two copies weigh log2(3); a text counts once for a pair; what stands beside a lost character is no pair.
    assert counts[a * n + b] == pytest.approx(np.log2(3)) and counts[e * n + e] == 1
    assert sum(counts.values()) == pytest.approx(3 * np.log2(3) + 3 + 2 + 2)


def test_segments_isolate(model):
    """Segments leave nearly all rightly read runs out, also in texts that are garbled elsewhere."""
    fix = mojibake.Restorer(model)
    clean = [(t, len(mojibake._HIGH.findall(t)), len(fix._runs(t))) for t in CLEAN]
    assert sum(hit for _, _, hit in clean) <= 0.1 * sum(n for _, n, _ in clean), clean
    mixed = garble("Prüfung", "utf-8", "cp1252") + " Schlüsselkasten Höhe"
    assert [mixed[s:e] for s, e in fix._runs(mixed)] == ["Ã¼"]
    assert all(fix._runs(bad) for _, bad in cases())


def test_lost_bytes_are_suspect_runs_without_an_inverse(model):
    fix = mojibake.Restorer(model)
    for text in ("Zone \ufffd east", "B\ufffdtiment c\ufffdt\ufffd", "Ã?tanchéité", "RéÃ?ption", "\ufffd" * 9):
        assert fix(text) == (True, None), text
    for text in ("Qu’est-ce?", "façade?", "AMANHÃ?"):
        assert fix(text) == (False, None), text


def test_dataframe(spark):
    rows = [("task", i, t) for i, t in enumerate(CLEAN * 50)] + [("task", 9000, "RÃ©ception du bÃ¢timent cÃ´tÃ© quai"), ("task", 9001, None), ("task", 9002, ""), ("task", 9000, "RÃ©ception du bÃ¢timent cÃ´tÃ© quai")]
    df = spark.createDataFrame(rows, "record_source string, record_id bigint, text string").selectExpr("*", "1 AS restored", "2 AS pair", "3 AS n")
    got = mojibake.restore_names(df).collect()
    assert [(r["record_id"], r["restored"], r["n"]) for r in got] == [(9000, "Réception du bâtiment côté quai", 3)] * 2
    assert mojibake.restore_names(df.limit(0)).count() == 0
    assert np.isfinite(mojibake.fit(df.limit(0)).log_p).all()


def test_repeated_garbling_stays_garbled(spark):
    bad = {garble(t, "utf-8", "cp1252"): t for t in ("Montaż słupów", "Réception côté quai", "Survey 10 m³ sump", "client’s spares", "Проверка линии")}
    plain = [(f"Montaz slupow {i}",) for i in range(200)] + [(t,) for t in CLEAN] * 20
    bad |= {garble(garble(t, "utf-8", "cp1252"), "utf-8", "cp1252"): t for t in ("Réception côté quai", "Устройство с дренажа")}
    for copies in (1, 4, 300):
        # Repeats of one name, and a source that is wholly garbled: distinct names with the same letters.
        rows = plain + [(b,) for b in bad] * copies + [(f"{b} {i}",) for b in bad for i in range(copies)]
        got = {r["text"]: r["restored"] for r in mojibake.restore_names(spark.createDataFrame(rows, "text string")).collect()}
        assert got == {**bad, **{f"{b} {i}": f"{t} {i}" for b, t in bad.items() for i in range(copies)}}


def test_writing_that_happens_to_be_utf8_stays():
    names = ["Paris–Évry", "AMANHÃ” ÁREA", "CAFÉ® bar", "ось Р–2", "сад", "“être”", "Проект РІ 5"]
    fix = mojibake.Restorer(fitted(CLEAN + [f"{n} {i}" for n in names for i in range(300)]))
    assert [n for n in names if fix(n)[0]] == []
