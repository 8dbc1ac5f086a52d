import pytest
from pyspark.sql import functions as F

from hanmaru.llm import encodings

KOREAN = ["제조원 한결팜, 보고번호 12.", "직사광선을 피하고 25°C 이하에서 보관하십시오.", "함량이 3mg을 넘지 않으면 큰 문제는 없으나 상담하십시오."]
OTHERS = ["Le complément apporte 3 mg d’extrait.", "SABOR «MAÇÃ» EM PÓ, 95 g POR DOSE.", "Через 11 дней изменений не заметно.", "製造番号5779、含有量は28.2％です。", "PÂTE «À L’ÂNE» : N°9 ×2"]
CHAINS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp949"), ("cp949", "latin-1"), ("cp949", "utf-8"), ("cp1251", "latin-1")]


def garble(text, written, read):
    return encodings.DECODERS[read](text.encode(written))


@pytest.fixture(scope="module")
def corpus(spark):
    clean = [(i, t) for i, t in enumerate((KOREAN + OTHERS) * 6)]
    bad, n = {}, 1000
    for written, read in CHAINS:
        for t in KOREAN + OTHERS:
            try:
                g = garble(t, written, read)
            except UnicodeEncodeError:
                continue
            if g != t and encodings.NON_ASCII.search(g):
                bad[n] = (g, t)
                n += 1
    twice = encodings.DECODERS["cp1252"](encodings.DECODERS["cp1252"](KOREAN[1].encode()).encode())
    bad[n] = (KOREAN[0] + "\n" + twice, KOREAN[0] + "\n" + KOREAN[1])
    rows = clean + [(i, g) for i, (g, _) in bad.items()] + [(5000, None), (5001, ""), (5002, "x" * 200_000), (None, "Ã©")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")), bad


def test_found_are_the_garbled(corpus):
    df, bad = corpus
    found = {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()}
    assert not found - bad.keys()
    missed = {i: bad[i] for i in bad.keys() - found}
    assert not missed, missed


def test_restored(corpus):
    df, bad = corpus
    got = {r.doc_id: r for r in encodings.restored(df.drop("word"), "doc_id", "text").collect()}
    whole = [i for i, (g, _) in bad.items() if "�" not in g]
    assert sum(got[i].restored_text == bad[i][1] for i in whole) >= 0.95 * len(whole)
    assert all(got[i].lost_words > 0 for i in bad if "�" in got[i].restored_text)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encodings.garbled_documents(df, "doc_id", "text")[0].count() == 0
    assert encodings.restored(df, "doc_id", "text").count() == 0


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp949", "latin-1"), ("cp949", "gbk"), ("utf-8", "cp949")])
@pytest.mark.parametrize("copies", [1, 50])
def test_direction_does_not_follow_counts(spark, written, read, copies):
    clean = KOREAN[1]
    bad = garble(clean, written, read)
    rows = [(0, clean), (1, KOREAN[0])] + [(100 + i, bad) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()} == set(range(100, 100 + copies))
    got = {r.restored_text for r in encodings.restored(df, "doc_id", "text").collect()}
    assert len(got) == 1 and ("�" in bad or got == {clean})


def test_clean_vietnamese_is_no_form_of_its_garbled_words(spark):
    clean = "Hàm lượng đo được là 24.9%."
    df = spark.createDataFrame([(0, clean)] + [(i, garble(clean, "utf-8", "cp1252")) for i in range(1, 5)], "doc_id long, text string")
    assert {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("read", ["mac_roman", "cp437", "cp1251", "cp850"])
def test_single_accents_between_one_byte_encodings(spark, read):
    texts = ["Le complément apporte du zinc.", "La dose journalière et la durée.", "Die Prüfung der Nährstoffe.", "Não há alteração de açúcar."]
    bad = [garble(t, "cp1252", read) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()} == {100 + i for i, t in enumerate(bad) if t != texts[i]}


def test_words_of_single_documents_are_originals(spark):
    """Planted: every garbled word has its original in one document only."""
    names = [f"{a}{b}풀{c}" for a in "가나다라마바사" for b in "노도로모보소" for c in "잎꽃"]
    clean = [(i, f"원료 {n} 함유") for i, n in enumerate(names)]
    bad = [(1000 + i, garble(f"{n} 12mg", "utf-8", read)) for i, (n, read) in enumerate(zip(names, ["latin-1", "cp1252", "cp949", "mac_roman"] * 50, strict=False))]
    df = spark.createDataFrame(clean + bad, "doc_id long, text string")
    found = {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()}
    assert not found & {i for i, _ in clean}
    assert len(found) >= 0.9 * len(bad)


def test_forms_do_not_go_through_the_driver(spark, corpus, monkeypatch):
    """The file of the words is small, their forms are many: the planner would broadcast them."""
    plans, cut = {}, encodings.write_through
    monkeypatch.setattr(encodings, "write_through", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or cut(df, name))
    df, bad = corpus
    assert not {r.doc_id for r in encodings.garbled_documents(df, "doc_id", "text")[0].collect()} - bad.keys()
    assert not [name for name in ("directed", "garbled-words") if "BroadcastHashJoin" in plans[name]]
