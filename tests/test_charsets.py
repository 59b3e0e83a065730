"""Labelled bodies in many charsets: whole texts and their first sentences."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.charsets import sniffed
from pagemill.sources.web import with_text

TEXTS = {
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由，不分种族、肤色、性别、语言、宗教、政治或其他见解。",
    "tw": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。人人有資格享有本宣言所載的一切權利和自由，不分種族、膚色、性別、語言、宗教、政治或其他見解。",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. À l'été, ça et là.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Straße, Größe, Übung – „schön“.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa, żółć.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má všechna práva, příliš žluťoučký kůň.",
}
LABELS = [
    ("ru", "windows-1251"), ("ru", "koi8-r"), ("el", "windows-1253"), ("ja", "shift_jis"), ("ja", "euc_jp"), ("ja", "iso2022_jp"), ("ko", "euc_kr"), ("zh", "gb18030"), ("tw", "big5"),
    ("fr", "windows-1252"), ("de", "windows-1252"), ("pl", "iso-8859-2"), ("cs", "iso-8859-2"), *((k, c) for k in TEXTS for c in ("utf-8", "utf-16-le", "utf-16-be")),
]


def _bodies():
    for key, charset in LABELS:
        whole = TEXTS[key]
        stop = next(i for i, c in enumerate(whole) if c in ".。") + 1
        for text in (whole, whole[:stop], f"<html><body><p class='x'>{whole}</p><p>{whole}</p></body></html>", whole * 400):
            yield text.replace("–", "-").replace("„", '"').replace("“", '"') if charset == "iso-8859-2" else text, charset


def test_labelled_bodies(spark):
    rows = [(i, text, charset, text.encode(charset)) for i, (text, charset) in enumerate(_bodies())]
    df = spark.createDataFrame(rows, "i int, text string, charset string, body binary")
    got = {r.i: (r.got, r.back) for r in with_text(df.select("i", "body", sniffed(F.col("body")).alias("got"), F.lit("text/html").alias("content_type")), "back").collect()}
    wrong = [(charset, got[i][0], len(text)) for i, text, charset, _ in rows if charset != got[i][0] and not (charset.startswith("utf-16") and got[i][1] == text)]
    # Text without ASCII has few zero bytes in UTF-16, so that without a mark nothing tells it.
    told = [w for w in wrong if not w[0].startswith("utf-16")]
    assert told == [], told
    assert all(got[i][1] == text for i, text, charset, _ in rows if not charset.startswith("utf-16"))
    assert len(rows) - len(wrong) >= 0.9 * len(rows), wrong


@pytest.mark.parametrize(("body", "want"), [
    (None, None), (b"", "utf-8"), (b"plain", "utf-8"), (b"\xef\xbb\xbfa", "utf-8"), (b"\xff\xfea\x00", "utf-16-le"), (b"\xfe\xff\x00a", "utf-16-be"), (b"caf\xe9", "windows-1252"), (b"\xe9", "windows-1252"),
    (b"a\x00b" * 9, "utf-8"), (b"\x00", "utf-8"), (bytes(range(256)), "utf-8"), ("é".encode() * 100_000, "utf-8"), (b"x" * 300_000 + b" \xe9t\xe9 ", "windows-1252"),
])
def test_single_bodies(spark, body, want):
    (r,) = spark.createDataFrame([(body,)], "body binary").select(sniffed(F.col("body")).alias("s")).collect()
    assert r.s == want


def test_declared_comes_first(spark):
    rows = [("text/html; charset=koi8-r", TEXTS["ru"].encode("koi8-r")), (None, b"<meta charset='windows-1251'>" + TEXTS["ru"].encode("cp1251")), (None, "﻿ok".encode("utf-16-le")), (None, None)]
    got = [r.guess_ for r in with_text(spark.createDataFrame(rows, "content_type string, body binary").withColumn("guess", F.lit(1)), "guess_").collect()]
    assert got == [TEXTS["ru"], "<meta charset='windows-1251'>" + TEXTS["ru"], "ok", None]


@pytest.mark.parametrize("text", [
    "Tz beungung und enützau lichtzach ieungte den der.iess", "Enung enäkeit schbekeit eingech schheit.", "Enä, die loweieu im loweizer ieein enenge sten geverheit enersch den enlichauge.", "Ükeit " * 11 + "enstauö " * 7,
    "Ééon. Er le èêou the oningat reenth thanheea eranhatish", "Èéen " * 60 + "ançpa " * 30, "Ñí, " * 50 + "eciónke miie miie miie miie miie ja " * 25, "ENPFÄÄ!! SCHÜKEIT ERÄACH!! CHÖÜ.!! ERVERHEITGE!! ", "Éçonoi tre la de aiqueai euxment ier èeux lementque. Ier, le.",
])
def test_accents_side_by_side_are_latin(spark, text):
    (r,) = spark.createDataFrame([(text.encode("latin-1"),)], "body binary").select(sniffed(F.col("body")).alias("s")).collect()
    assert r.s == "windows-1252"


@pytest.mark.parametrize(("text", "charset"), [("<ul>" + "<li><a href='/list/of/links'>中文</a></li>" * 9 + "</ul>", "gb18030"), ("使用Spark处理大规模数据，并与Hadoop比较。", "gb18030"), ("中文", "gb18030"), ("使用Spark處理大規模資料，並與Hadoop比較。", "big5")])
def test_characters_among_ascii_stay(spark, text, charset):
    (r,) = spark.createDataFrame([(text.encode(charset),)], "body binary").select(sniffed(F.col("body")).alias("s")).collect()
    assert r.s == charset
