"""Scripts, stop words and language detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges as regex class bodies.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
ARABIC = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
URDU_ONLY = "ٹڈڑںھےہگچپژکی"
GERMAN_CHARS = "äöüß"
CJK_WEIGHT = 2.5

# Stop words by language.
STOPWORDS = {
    "en": """
        a an and are as at be but by can could did do does for from had has have how i if in into is it its me my not of on or our
        per should so than that the their there these they this to us was we were what when where which who why will with would you
        your about""".split(),
    "de": """
        aber alle als also am an auch auf aus bei beim bin bis bist da damit dann das dass dem den denn der des dessen die dies diese
        diesem diesen dieser dieses doch dort du durch ein eine einem einen einer eines er es etwas euer eure fuer für gegen gewesen
        hab habe haben hat hatte hatten hier hin ihr ihre ihrem ihren ihrer ihres im in ist ja jede jedem jeden jeder jedes jene kann
        kannst koennen können machen man mehr mein meine mit muss müssen nach nicht noch nun nur ob oder ohne schon sehr sein seine
        seinem seinen seiner sich sie sind so soll sollen ueber über um und uns unser unsere vom von vor waehrend war waren warum was
        weil weiter welche wenn wer werden wie wieder wir wird wirst wo wurde wurden zu zum zur zwar zwischen""".split(),
    "ar": """
        في من على إلى عن مع هذا هذه هذان ذلك تلك التي الذي الذين ما ماذا لا لم لن ان أن إن أو او ثم حتى إذا اذا كما بين هناك هنا هو هي
        هم هن نحن أنا انا أنت انت كان كانت يكون تكون قد كل بعض عند عندما لكن لكي كي به بها له لها لهم وهو وهي التى الي الى و يا اي أي
        كيف اين أين متى مته لدى سوف قبل بعد""".split(),
    "ur": """
        کا کی کے کو میں سے پر نے ہے ہیں تھا تھی تھے اور یا لیکن جو کہ یہ وہ ان اس ہم آپ نہیں بھی تو ہی کیا کیوں کب کہاں کون کس ایک ساتھ
        لیے لئے بارے پھر اگر جب تک ہر کچھ بہت زیادہ کم اپنے اپنی اپنا وغیرہ گیا گئی گئے کرنے کرنا ہوتا ہوتی ہوتے رہا رہی رہے دیا دی دیے
        والا والی والے""".split(),
}
CHINESE_STOP_CHARS = "的了是在和有我你他她它们这那就不也与及为之以于或但而都很吗呢吧个一被把让从对向所并且还又只再没什么怎哪些当因所以如果虽然然后可以"
LANGUAGE_NAMES = {"en": "English", "de": "German", "ar": "Arabic", "zh": "Chinese", "ur": "Urdu"}

GERMAN_ONLY = [w for w in STOPWORDS["de"] if w not in set(STOPWORDS["en"])]
ENGLISH_ONLY = [w for w in STOPWORDS["en"] if w not in set(STOPWORDS["de"])]


def listed_in(word: Column, words: list[str]) -> Column:
    """Whether a word is listed: Spark makes a hash set of the list."""
    return word.isin(words)


def hits(words: Column, listed: list[str]) -> Column:
    """How many of the words (with repeats) are listed."""
    return F.size(F.filter(words, lambda w: listed_in(w, listed)))


def script_counts(text: Column) -> dict[str, Column]:
    """Letters by script; one Chinese or Japanese character weighs as much as a short word."""
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")
    only = lambda cls: F.length(F.regexp_replace(letters, f"[^{cls}]+", "")).cast("double")
    return {"latin": only("\\x{00}-\\x{036f}"), "arabic": only(ARABIC), "cjk": only(CJK) * CJK_WEIGHT}


def english_or_german(text: Column) -> Column:
    """en, or de if German has enough evidence of its own."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9äöüß]+"), F.lit(0)), lambda w: ~w.rlike("[0-9]"))
    de, en = hits(words, GERMAN_ONLY), hits(words, ENGLISH_ONLY)
    long_de = hits(words, [w for w in GERMAN_ONLY if len(w) > 2])
    chars = F.length(F.regexp_replace(low, f"[^{GERMAN_CHARS}]+", ""))
    n = F.size(words)
    score = de + chars * 2
    needed = F.when(chars > 0, 2).otherwise(3)
    few = (en == 0) & (de >= 2) & (n >= 6) & (de / n >= 0.2)
    needed = F.when(few, F.least(needed, de)).otherwise(needed)
    german = (n > 0) & ((chars > 0) | (long_de > 0)) & (score >= needed) & (score > en)
    return F.when(german, "de").otherwise("en")


def arabic_or_urdu(text: Column) -> Column:
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, "^[،۔؟!.,]+|[،۔؟!.,]+$", ""))
    return F.when(text.rlike(f"[{URDU_ONLY}]"), "ur").when(hits(words, STOPWORDS["ur"]) > hits(words, STOPWORDS["ar"]), "ur").otherwise("ar")


def detect_language(text: Column) -> Column:
    """Code of the language that contributes most; en when nothing is known."""

    def by_script(n: Column) -> Column:
        latin, arabic, cjk = n["latin"], n["arabic"], n["cjk"]
        return (
            F.when(text.isNull() | (latin + arabic + cjk == 0), "en")
            .when((cjk > latin) & (cjk > arabic), "zh")
            .when(arabic > latin, arabic_or_urdu(text))
            .otherwise(english_or_german(text))
        )

    # bound once, so that the letters aren't counted again for every comparison
    counted = F.transform(F.array(F.struct(*[c.alias(name) for name, c in script_counts(text).items()])), by_script)[0]
    # most texts have one script, which what is left without ASCII shows
    rest = F.regexp_replace(text, r"[\x00-\x7f]+", "")
    return F.when(~rest.rlike(f"[{ARABIC}{CJK}]"), english_or_german(text)).otherwise(counted)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, code), F.lit("English"))
