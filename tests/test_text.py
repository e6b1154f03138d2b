from pyspark.sql import functions as F

from recordloom.functions import dictionary as D
from recordloom.functions import text as T
from tests.conftest import value, values

L = F.lit


def test_norm_text(spark):
    got = values(spark, a=T.norm_text(L("  iPhone-15, PRO!! ")), b=T.norm_text(L("ＡＢＣ　１")), c=T.norm_text(L(None).cast("string")), d=T.norm_text(L("黒（革）")), e=T.norm_text(L("ｶﾊﾞﾝ")), f=T.norm_text(L("ﬁne №①½ ㌔ e\u0301")))
    assert got == {"a": "iphone 15 pro", "b": "abc 1", "c": "", "d": "黒 革", "e": "カバン", "f": "fine no11⁄2 キロ é"}


def test_norm_text_folds_as_dictionaries_do(spark):
    import random
    import unicodedata

    rng = random.Random(1)
    odd = [c for c in map(chr, (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D500))) if unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc") and unicodedata.normalize("NFKC", c) != c]
    texts = ["".join(rng.choice(odd + list("abcé かカ.-")) for _ in range(8)) for _ in range(2000)] + odd
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm_text(F.col("t")).alias("n")).collect()
    assert all(r.n == D.plain(r.t) for r in rows)


def test_dictionaries_meet_texts_in_other_forms(spark):
    section = {"bag": ("カバン",), "first": ("①",), "fine": ("ﬁne",)}
    got = values(spark, a=D.canonical(L("ｶﾊﾞﾝ"), section), b=D.canonical(L("1"), section), c=D.canonical(L("FINE"), section), d=F.array_join(F.transform(D.all_hits(L("黒いｶﾊﾞﾝ"), section), lambda h: h["canonical"]), ","))
    assert got == {"a": "bag", "b": "first", "c": "fine", "d": "bag"}


def test_overlap(spark):
    got = values(spark, same=T.text_overlap(L("cat sticker"), L("Cat Sticker")), none=T.text_overlap(L(""), L("x")), half=T.text_overlap(L("猫咪贴纸"), L("猫咪图案")), sub=T.text_overlap(L("ab"), L("abcd")))
    assert got == {"same": 1.0, "none": 0.0, "half": 0.5, "sub": 1.0}


def test_report_phrases_never_leave_nothing(spark):
    got = values(spark, a=T.strip_phrases(L("I lost a black bag.")), b=T.strip_phrases(L("lost")), c=T.strip_phrases(L("黒い鞄を紛失しました")))
    assert got["a"] == "I black bag" or "black bag" in got["a"]
    assert got["b"] == "lost" and got["c"] == "黒い鞄"


def test_patterns(spark):
    got = values(
        spark, imei=T.imeis(L("imei 123456789012345 end")), glued=T.imeis(L("号123456789012345号")), serial=T.serials(L("sn AB12CD34EF, word backpack 99")), loose=T.serials(L("backpack no 99"), strict_reference=True),
        model=T.canonical_model(T.model_phrase(L("my iPhone 15 Pro Max here"))), brand=T.brand_of_model(L("galaxy s21")), window=T.window_before(L("with a cat sticker on it"), "sticker", 4), gone=T.window_before(L("none"), "sticker"),
    )
    assert got["imei"] == ["123456789012345"] and got["glued"] == []
    assert got["serial"] == ["AB12CD34EF"] and got["loose"] == ["backpack"]
    assert got["model"] == "iphone 15 pro max" and got["brand"] == "Samsung" and got["window"] == "cat sticker" and got["gone"] == ""


def test_grams_and_lines(spark):
    got = values(spark, g=T.grams(L("a bcd")), short=T.grams(L("ab")), none=T.grams(L(None).cast("string")), lines=T.canonical_lines(F.create_map(L("b"), L("2"), L("a"), L("1"), L("c"), L(""))), cut=T.ellipsis(L("abcdef"), 3))
    assert got == {"g": ["abc", "bcd"], "short": [], "none": [], "lines": "a: 1\nb: 2", "cut": "abc…"}


def test_image_prompt(spark):
    got = values(spark, a=T.image_prompt(L("orange"), L(None).cast("string"), L(None).cast("string"), L("water_bottle")), b=T.image_prompt(L("red"), L("leather"), L(None).cast("string"), L("bag")), c=T.image_prompt(*[L(None).cast("string")] * 4))
    assert got == {"a": "a photo of an orange water bottle", "b": "a photo of a red leather bag", "c": None}


SECTION = {"bag": ("鞄", "handbag"), "keys": ("key",), "sake": ("日本酒",), "water_bottle": ("bottle",), "_note": ("x",)}


def test_alias_boundaries(spark):
    tags = lambda t: value(spark, F.transform(D.all_hits(L(t), SECTION), lambda h: h["canonical"]))
    assert tags("my baggage and a monkey") == []
    assert tags("a BAG, a key") == ["bag", "keys"]
    assert tags("黒い鞄を紛失") == ["bag"]
    assert tags("鞄屋") == []
    assert tags("a bottle of 日本酒") == ["water_bottle", "sake"]


def test_canonical(spark):
    got = values(spark, exact=D.canonical(L("HandBag"), SECTION), inside=D.canonical(L("red handbag"), SECTION), none=D.canonical(L("chair"), SECTION, strict=True), free=D.canonical(L(" Chair "), SECTION), empty=D.canonical(L(""), SECTION))
    assert got == {"exact": "bag", "inside": "bag", "none": None, "free": "chair", "empty": None}


def test_codes_and_colors(spark):
    got = values(spark, a=D.attribute_code(L("颜色")), b=D.attribute_code(L("Case_Type")), c=D.attribute_code(L("Weight")), d=D.color_family(L("Dark Gray")), e=D.color_family(L("shiny navy blue")), f=D.color_family(L("beige")), g=D.color_family(L("")))
    assert got == {"a": "color", "b": "case", "c": "weight", "d": "black", "e": "blue", "f": "beige", "g": None}


def test_terms(spark):
    got = values(spark, a=D.canonical_term(L("Acme Storage"), ("Acme", "The Acme"), {"cheap": ("low cost",)}), b=D.canonical_term(L("Low Cost"), ("Acme",), {"cheap": ("low cost",)}), c=D.tag_set(L("use s3 and glacier; index"), {"S3": ("s3",), "Connect": ("dx",), "Archive": ("glacier",)}))
    assert got == {"a": "storage", "b": "cheap", "c": ["Archive", "S3"]}


def test_longest_alias(spark):
    docs = spark.createDataFrame([(1, "an old ring"), (2, "a ring"), (3, "nothing")], "id int, t string")
    got = {r.id: (r.canonical, r.alias) for r in D.tag_longest(docs, "id", "t", D.alias_table(spark, {"a": ("ring",), "b": ("old ring",)})).collect()}
    assert got == {1: ("b", "old ring"), 2: ("a", "ring")}
