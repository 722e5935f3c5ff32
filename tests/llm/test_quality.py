import random

import pytest

from codelattice.llm import quality, queries

PROSE = ["The parser reads the file that was changed, and it keeps the rows in a table.", "When the branch is moved, all of the old rows are dropped before the new ones are written.", "Der Bericht nennt die Dateien, die sich seit dem letzten Lauf geändert haben.", "La table garde les lignes du fichier qui n'a pas changé depuis la dernière fois.", "El informe muestra los archivos que no se han leído en la última ejecución.", "索引は変更されたファイルだけを読み込み、結果を表に保存します。"]


def make(rng, kind):
    n = rng.randint(4, 30)
    if kind == "prose":
        return rng.choice([" ", "\n\n", "\n"]).join(rng.choice(PROSE) for _ in range(n))
    if kind == "list":
        return "\n".join(f"{rng.choice('-*+')} {rng.choice(['open', 'read', 'sort'])}_{rng.choice(['row', 'file', 'key'])}" for _ in range(n))
    if kind == "table":
        return "\n".join("| " + " | ".join(rng.choice(["row", "0.3", "-", "81", "key"]) for _ in range(4)) + " |" for _ in range(n))
    return rng.choice(["\n".join(f"{rng.randint(0, 1 << 31):08x}  " + " ".join(f"{rng.randint(0, 255):02x}" for _ in range(16)) for _ in range(n)), "\n".join(f"    {rng.choice('abc')}x = load_{rng.choice('pqr')}(y[{rng.randint(0, 9)}]);" for _ in range(n)), "".join(rng.choice("{}[]<>/*%$#@!^&=+|~ ") for _ in range(n * 10))])


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    kinds = ["prose"] * 6 + ["list", "table", "junk"]
    data = [(i, k, make(rng, k)) for i, k in enumerate(rng.choice(kinds) for _ in range(700))]
    df = spark.createDataFrame(data, "doc_id long, truth string, text string")
    told = {r.doc: r.kind for r in quality.classify_documents(df).collect()}
    assert len(told) == 700
    assert sum((told[i] == "prose") == (k == "prose") for i, k, _ in data) >= 0.98 * len(data)
    assert sum(told[i] == k for i, k, _ in data) >= 0.9 * len(data)


OTHER_LANGUAGES = {
    "ru": ["Мы долго искали дом, но на улице не было никого, кто мог бы нам помочь.", "Вечером он сказал, что завтра все будут дома.", "Книга, которую вы дали мне, была очень интересной."],
    "pl": ["Kiedy wrócili do domu, było już ciemno i nikt nie czekał przy drzwiach.", "Nie wiem, czy to jest dobra droga, ale możemy spróbować.", "Książka, która leży na stole, jest dla ciebie."],
    "zh": ["我们昨天去了山上，因为天气很好，孩子们也不想在家里。", "他说他会在下个月回来，到时候我们就可以一起走。", "这本书是我的，不过你可以把它带回家。"],
    "ko": ["우리는 어제 산에 갔지만 비가 와서 일찍 집으로 돌아왔다.", "그는 다음 달에 돌아올 것이라고 말했습니다.", "이 책은 제가 가장 좋아하는 책이에요."],
    "it": ["Quando siamo arrivati alla stazione, il treno era già partito e non c'era più nessuno.", "La casa è grande, ma il giardino è senza alberi."],
}


def test_prose_of_other_languages_is_kept(spark):
    rng = random.Random(5)
    data = [(i, make(rng, rng.choice(["prose"] * 6 + ["list", "table", "junk"]))) for i in range(500)]
    others = [" ".join(rng.choice(texts) for _ in range(rng.randint(3, 12))) for texts in OTHER_LANGUAGES.values() for _ in range(6)]
    df = spark.createDataFrame(data + [(1000 + i, t) for i, t in enumerate(others)], "doc_id long, text string")
    told = {r.doc: r.kind for r in quality.classify_documents(df).collect()}
    assert sum(told[1000 + i] == "prose" for i in range(len(others))) >= 0.95 * len(others)


def test_mixture_overrules_the_share_of_sentences(spark):
    """Texts of broken bytes whose words pass for sentences are not prose."""
    rng = random.Random(8)
    data = [(i, make(rng, "prose" if i % 4 else "junk")) for i in range(400)]
    broken = ["".join("\ufffd" if rng.random() < 0.17 else ch for ch in PROSE[rng.choice([0, 1, 2, 4])].replace("e", "\u00c3\u00a9") * 4) for _ in range(20)]
    df = spark.createDataFrame(data + [(1000 + i, t) for i, t in enumerate(broken)], "doc_id long, text string")
    rows = {r.doc: r for r in quality.classify_documents(df).collect()}
    passing = [rows[i] for i in rows if i >= 1000 and rows[i].sentence_share >= 0.5]
    assert len(passing) >= 10 and sum(r.kind != "prose" for r in passing) >= 0.9 * len(passing)


@pytest.mark.parametrize(
    ("text", "prose"),
    [
        (" ".join(PROSE[:2]), True),
        (" ".join(PROSE[:2]).upper(), True),
        (" ".join(PROSE[:2]).lower().replace(".", "").replace(",", ""), True),
        ("\n".join("> " + w for w in ["The parser reads the file that was", "changed, and it keeps the rows", "in a table."]), True),
        ("The\nparser reads\nthe file that was\r\nchanged, and it keeps the\r\nrows in a table.", True),
        ("# Head\n\n" + PROSE[2] + "\n\n- a_b\n- c_d", True),
        (PROSE[0] + "\n\n" + "\n".join(f"- open_file_{i}" for i in range(60)), False),
        (PROSE[5], True),
        ("Wnoyrr unj ok jn phwbyby. Uowcj fivl wzzdzikzp sq lss nbxukm puyo tekiud df ncljiauk.", False),
        ("n/a", False), ("", False), (None, False), (" \t\n", False), ("-", False),
    ],
)
def test_share_of_sentences(text, prose):
    assert (quality.measure(text)[-1] >= 0.5) == prose


def test_statistics_by_hand():
    n_words, mean, symbols, digits, ends, common, bullets, tables_, _ = quality.measure("The cat sat.\n\n- it is 42\n")
    assert (n_words, round(mean, 2)) == (5, 2.6)
    assert round(digits, 3) == round(2 / 17, 3) and round(symbols, 3) == round(2 / 17, 3)
    assert (ends, common, bullets, tables_) == (0.5, 0.6, 0.5, 0.0)


def test_long_null_empty_and_missing_rows(spark, tables):
    data = [(1, PROSE[0] * 3_000, "e"), (2, None, "e"), (3, "", "e"), (4, "x" * 100_000, "e"), (5, PROSE[1], "e"), (5, PROSE[1], "e"), (None, PROSE[2], "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, kind string")
    d = tables(documents=df)
    got = sorted(r.doc_id for r in queries.p9_found(spark, d).collect())
    assert got == [2, 3, 4]
    assert queries.p9_statistics(spark, d).count() == 7
    d = tables(documents=df.limit(0))
    assert queries.p9_found(spark, d).count() == 0
