"""Expressions on hand-made cases."""

import hashlib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fulltext, hosting, links, registration, strings, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "folded"),
    [("Vallières", "Vallieres"), ("ÀÉÎõü", "AEIou"), ("œuvre", "œuvre"), ("", ""), ("Ångström Żółć", "Angstrom Zołc"), ("Nguyễn Ștefan", "Nguyen Stefan"), ("Ḿ ǅ Ἀθῆναι Й", "M ǅ Αθηναι И"), ("e\u0301 한글", "e 한글"), ("が", "か")],
)
def test_accent_fold(spark, text, folded):
    assert value(spark, strings.accent_fold(F.lit(text))) == folded


def test_accents_of_all_letters(spark):
    """Against the decomposition itself, for every letter of the scripts with accents."""
    letters = [chr(c) for block in ((0xC0, 0x370), (0x370, 0x530), (0x1E00, 0x2000)) for c in range(*block) if unicodedata.category(chr(c))[0] == "L"]
    rows = spark.createDataFrame([(x,) for x in letters], "x string").select("x", strings.accent_fold("x").alias("y")).collect()
    want = {x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M") for x in letters}
    assert {r["x"]: r["y"] for r in rows} == want


@pytest.mark.parametrize("text", ["&#233;&mdash;&uuml;", "&amp;lt; &AMP &notin; &notit; &#x1F600;&#0;&#128;", "a & b &unknown; &", "no entity", None, "&lt;p&gt;<p>&nbsp;x&nbsp;</p>&eacute"])
def test_entities(spark, text):
    assert value(spark, strings.decoded(F.lit(text))) == (None if text is None else html.unescape(text))
    plain = "" if text is None else html.unescape(re.sub("<[^>]+>", " ", re.sub("</p>", "\n", text)))
    lines = [re.sub(r"\s+", " ", x).strip() for x in plain.splitlines()]
    assert value(spark, strings.html_to_text(F.lit(text))) == "\n".join(x for x in lines if x)


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("The Acting Speaker (Mr. Ray Hall)", "Mr. Ray Hall"), ("Mr. The Deputy Chair ( Ann Li )", "Ann Li"), ("the  assistant deputy speaker (X)", "X"), ("The Vice-Chair (Ms. Li)", "Ms. Li"), ("Hon. The Chairperson (A (B)", "A (B"),
        ("The Speaker", None), ("The Speaker ()", None), ("Speaker (X)", None), ("The Minister (X)", None), ("The Speaker (X) said", None), ("Mr. Mr. The Speaker (X)", None), ("", None), (None, None),
    ],
)
def test_presiding_names_behind_titles(spark, line, name):
    assert value(spark, strings.presiding_name(F.lit(line).cast("string"))) == name


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Mrs. Ann Tall (York—Hill, ABC)", ("Ann Tall", "ABC", "York—Hill", None)),
        ("Hon. Jo Low (East, XY.)", ("Jo Low", "XY", "East", None)),
        ("The Speaker", ("The Speaker", None, None, "The Speaker")),
        ("The Vice-Chair (Ms. Li Wu)", ("The Vice-Chair (Ms. Li Wu)", None, None, "The Vice-Chair (Ms. Li Wu)")),
        ("Somebody", ("Somebody", None, None, None)),
    ],
)
def test_attribution(spark, line, want):
    assert tuple(value(spark, strings.attribution(F.lit(line)))) == want


@pytest.mark.parametrize(("text", "n"), [("", 1), ("a" * 26, 7), ("a" * 27, 8), ("a" * 1680, 480), ("a" * 7, 2), ("a" * 35, 10)])
def test_token_estimate(spark, text, n):
    assert value(spark, strings.token_estimate(F.lit(text))) == n


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("twitter.com/@Foo", ("twitter", "Foo")),
        ("https://www.facebook.com/profile.php?id=12", ("facebook", "id:12")),
        ("https://youtube.com/c/name/videos", ("youtube", "name")),
        ("https://ca.linkedin.com/in/abc/", ("linkedin", "abc")),
        ("https://mastodon.social/@me", ("mastodon", "@me@mastodon.social")),
        ("https://threads.net/@t", ("threads", "t")),
        ("https://x.com/home", ("other", None)),
        ("https://www.facebook.com/sharer.php", ("other", None)),
        ("https://twitter.com/i", ("other", None)),
        ("https://twitter.com/signup", ("other", None)),
        ("https://twitter.com/settings", ("twitter", "settings")),
        ("https://instagram.com/help", ("instagram", "help")),
        ("https://example.org/me", ("other", None)),
    ],
)
def test_canonical_social(spark, url, want):
    assert tuple(value(spark, links.canonical_social(F.lit(url)))) == want


def test_a_hint_tells_the_platform(spark):
    s = lambda url, hint: tuple(value(spark, links.canonical_social(F.lit(url), F.lit(hint))))
    assert s("https://example.social/@me", "Mastodon") == ("mastodon", "@me@example.social")
    assert s("https://example.org/@me", "x.com") == ("twitter", "me")
    assert s("https://example.org/me", None) == ("other", None)
    assert s("https://facebook.com/me", "twitter") == ("facebook", "me")


@pytest.mark.parametrize(
    ("search", "text", "want"),
    [
        ("red fox", "A red, quick fox", True),
        ("red fox", "a red dog", False),
        ('"quick fox"', "the quick fox", True),
        ('"quick fox"', "quick red fox", False),
        ("red -fox", "red dog", True),
        ("red -fox", "red fox", False),
        ("cat or dog", "dog", True),
        ("été", "L'Été", True),
        ("", "anything", False),
    ],
)
def test_matches(spark, search, text, want):
    assert value(spark, fulltext.matches(fulltext.lexemes(F.lit(text)), search)) is want
    assert value(spark, fulltext.says(F.lit(text), search)) is want


def test_analysers(spark):
    terms = lambda text, name: value(spark, fulltext.analysed(F.lit(text), name))
    assert terms("The Ministers were running policies", "simple") == ["the", "ministers", "were", "running", "policies"]
    assert terms("The ministers' policies and a policy", "english") == ["minist", "polici", "polici"]
    assert terms("Les gouvernements et le gouvernement", "french") == ["gouvern", "gouvern"]
    assert terms(None, "english") == []


def test_term_rank(spark):
    rank = lambda text: round(value(spark, fulltext.term_rank(fulltext.lexemes(F.lit(text)), ["a", "b"])), 6)
    assert rank("x") == 0 and rank("a x") == round(0.1 / 1.64493406685 / 2, 6)
    assert rank("a a b") == round(0.1 * 2.25 / 1.64493406685 / 2, 6)


def test_headline_fragments(spark):
    words = [f"w{k}" for k in range(120)]
    words[20] = words[30] = words[100] = "Hit,"
    out = value(spark, fulltext.headline(F.lit(" ".join(words)), ["hit"]))
    first, second = out.split(" … ")
    assert first.split()[0] == "w10" and len(first.split()) == 35 and first.count("<b>Hit,</b>") == 2
    assert second.split()[0] == "w90" and second.count("<b>") == 1
    assert value(spark, fulltext.headline(F.lit(" ".join(words)), ["none"])).split() == words[:15]


def test_html_to_text(spark):
    assert value(spark, strings.html_to_text(F.lit("<p>A &amp; <b>b</b></p ><p> c<br/>d</p>"))) == "A & b\nc\nd"
    assert value(spark, strings.html_to_text(F.lit(None).cast("string"))) == ""


def test_plurality_language(spark):
    text = '<p data-originallang="fr">x</p><p data-originallang="FR">y</p><p data-originallang="en">z</p>'
    assert value(spark, strings.plurality_language(F.lit(text))) == "fr"
    assert value(spark, strings.plurality_language(F.lit('data-originallang="fr" data-originallang="en"'))) == "en"


def test_postal_code(spark):
    assert value(spark, strings.postal_code(F.lit("k1a 0b1"))) == "K1A0B1"
    assert value(spark, strings.postal_code(F.lit("D1A 0B1"))) is None


def test_tier_ladder(spark):
    none = F.lit(None).cast("string")
    home, away = F.lit(True), F.lit(False)
    t = lambda country, at_home, cdn, provider, failed: value(spark, hosting.tier(country, at_home, cdn, provider, F.lit(failed)))
    assert t(F.lit("CA"), home, none, none, False) == 1
    assert t(F.lit("CA"), away, F.lit("Fastly"), none, False) == 2
    assert t(F.lit("US"), away, F.lit("Fastly"), none, False) == 3
    assert t(F.lit("US"), away, none, none, False) == 4
    assert t(F.lit("DE"), away, none, none, False) == 5
    assert t(none, away, none, F.lit("Wix"), False) == 5
    assert t(none, away, none, none, True) == 6
    assert value(spark, hosting.home_provider(F.lit("Some Net"), F.lit("AS577"), ["iweb"], [577])) is True


def test_profile_score(spark):
    s = lambda title, bio: round(value(spark, strings.profile_score(F.lit("Ann Tall"), F.lit("ABC"), F.lit("York"), F.lit(False), F.lit(False), F.lit(title), F.lit(bio), ["member of"], ["parody"])), 4)
    assert s("Ann Tall", "") == 0.55
    assert s("Ann Tall", "Member of house for York, ABC") == 1.0
    assert s("Bob", "member of") == 0.0
    assert s("Ann Tall parody", "") == 0.3


def test_content_hash_of_compatible_texts(spark):
    h = lambda text: value(spark, strings.content_hash(F.lit(text)))
    assert h("ﬁne  Ａ½") == h("fine a1⁄2") == hashlib.sha256("fine a1⁄2".encode()).hexdigest()
    assert h("a\u00a0b") == h("a b") and h(None) is None


def test_other_attributions(spark):
    a = lambda line: tuple(value(spark, strings.attribution_of(F.lit(line))))
    assert a("Mr. John Low (York East)") == ("John Low", "York East", None)
    assert a("Hon. Ann Tall, Minister of Health") == ("Ann Tall", None, "Minister of Health")
    assert a("The Deputy Speaker (Ms. Li Wu)") == ("Li Wu", None, "The Deputy Speaker")
    assert a("The Speaker:") == (None, None, "The Speaker")
    assert a("Mme Roy :") == ("Roy", None, None)


def test_site_score(spark):
    s = lambda host, link, near: value(spark, strings.site_score(F.lit(host), F.lit(link), F.lit(near), F.array(F.lit("anna"), F.lit("tall")), F.array(F.lit("oakville")), ["donate"]))
    assert s("annatall.ca", "", "") == 11
    assert s("annatall.ca", "donate", 'website rel="external"') == 13
    assert s("oakville.org", "", "her web site") == 11
    assert s("something.example.org", "", "") == 1


def test_scores_of_many_facts(spark):
    """Every rule of both scores, and their sums, by a plain reading on random facts."""
    rnd = random.Random(7)
    words = lambda t: {w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split() if len(w) >= 2}
    rows = []
    for k in range(300):
        pick = lambda *x: rnd.choice(x)
        rows.append((k, pick("Ann Tall", "Bo", ""), pick("ABC", "Long Party", None), pick("York Hill", "", None), rnd.random() < 0.3, rnd.random() < 0.3, pick("Ann Tall", "Ann of York", "Tall parody", "", None, "Bo abc"), pick("member of abc", "parody", "york", None, "")))

    def brute(name, party, place, own, other, title, bio):
        text = f"{title or ''} {bio or ''}".lower()
        overlap = len(words(name) & words(title)) / len(words(name)) if words(name) else 0.0
        if not title or not overlap:
            return 0.0
        political = "member of" in text
        total = 0.6 * overlap + 0.2 * political + 0.15 * any(w in text for w in words(place)) + 0.1 * own + 0.05 * any(w and len(w) <= 4 and w in text for w in (party or "").lower().split()) - 0.4 * other - 0.3 * ("parody" in text)
        return max(0.0, min(1.0, total if political else min(total, 0.55)))

    frame = spark.createDataFrame(rows, "k int, name string, party string, place string, own boolean, other boolean, title string, bio string")
    score = strings.profile_score(*[F.col(c) for c in ("name", "party", "place", "own", "other", "title", "bio")], ["member of"], ["parody"])
    got = {r["k"]: round(r["s"], 6) for r in frame.select("k", score.alias("s")).collect()}
    assert got == {r[0]: round(brute(*r[1:]), 6) for r in rows} and len(set(got.values())) > 12
    sites = [(k, rnd.choice(["annatall.ca", "www.anna-tall.example.org", "oakville.org", "x.co", "a.b.c.d"]), rnd.choice(["donate now", "", None]), rnd.choice(["her web site", 'rel="external"', "campaign", "websites", ""])) for k in range(200)]

    def brute_site(host, link, near):
        parts = [p for p in re.split(r"[.\-]", host.lower()) if len(p) >= 4]
        hits = lambda own: sum(any(w in p or p in w for w in own if len(w) >= 4) for p in parts)
        label, n = bool(re.search(r"\b(web ?site|web|campaign|personal)\b", near)), hits(["anna", "tall"])
        return 10 * n + 4 * label + 2 * ('rel="external"' in near) + 6 * (hits(["oakville"]) > 0 and label and n == 0) + (host.count(".") <= 2 and 4 <= len(host.split(".")[0]) <= 20) - 4 * ("donate" in (link or ""))

    frame = spark.createDataFrame(sites, "k int, host string, link string, near string")
    score = strings.site_score(F.col("host"), F.col("link"), F.col("near"), F.array(F.lit("anna"), F.lit("tall")), F.array(F.lit("oakville")), ["donate"])
    assert {r["k"]: r["s"] for r in frame.select("k", score.alias("s")).collect()} == {r[0]: brute_site(*r[1:]) for r in sites}


def test_canonical_terms(spark):
    t = lambda x: value(spark, strings.canonical_term(F.lit(x), {"1st reading": "First Reading"}))
    assert [t(" 1ST reading "), t("royal assent"), t(None)] == ["First Reading", "Royal Assent", None]


def test_tier_labels(spark):
    assert [value(spark, hosting.tier_label(F.lit(k))) for k in (1, 2, 6, 9)] == ["Canadian Sovereign", "Canadian Soil", "Unknown", "Unknown"]


def test_query_prefix():
    class Echo:
        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    assert vectors.encode_query(Echo(), "abc") == [float(len(vectors.QUERY_PREFIX) + 3)]


def test_sql_functions(spark):
    names = registration.register_udfs(spark)
    row = spark.sql("SELECT accentless('Vallières') a, token_count('aaaaaaa') b, url_host('https://E.org/x') c, letter_grade(70) d, nfkc('ﬁ') e, sanitised_html('<script>x</script><p>y') f").first()
    assert tuple(row) == ("Vallieres", 2, "e.org", "B", "fi", "<p>y</p>") and len(names) == 6
