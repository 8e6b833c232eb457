"""Stems against the samples that the algorithms are published with."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import stemmers

#: Published pairs of a word and its stem.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
FRENCH = """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel
continuellement continuel continuelles continuel continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu continuité continu
continuons continuon contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour contractait contract contracté contract
contractée contract contracter contract contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint
contrainte contraint contraintes contraint contraire contrair contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten
maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair mais mais maïs maï maison maison maisons maison maistre maistr maitre maitr
maître maîtr maîtres maîtr maîtresse maîtress maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majeure majeur major major
majordome majordom majordomes majordom majorité major majorités major mal mal malacca malacc malade malad malades malad maladie malad maladies malad maladive malad""".split()
#: Words that show one rule each.
MORE_ENGLISH = {
    "running": "run", "controlling": "control", "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed", "caresses": "caress", "ponies": "poni", "ties": "tie", "gas": "gas", "gaps": "gap", "this": "this", "kiwis": "kiwi",
    "skies": "sky", "dying": "die", "early": "earli", "news": "news", "proceed": "proceed", "exceeding": "exceed", "generate": "generat", "generous": "generous", "communism": "communism", "arsenal": "arsenal", "say": "say", "by": "by", "cry": "cri",
    "happy": "happi", "enjoy": "enjoy", "youth": "youth", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "hopefulness": "hope", "apology": "apolog", "geology": "geolog", "nationally": "nation",
    "triplicate": "triplic", "formative": "format", "electrical": "electr", "adoption": "adopt", "opinion": "opinion", "bowdlerize": "bowdler", "rate": "rate", "cease": "ceas", "controll": "control", "luxuriated": "luxuri", "bed": "bed", "shed": "shed",
    "disabled": "disabl", "sized": "size", "filing": "file", "failing": "fail", "falling": "fall", "hissing": "hiss", "at": "at", "a": "a", "bias": "bias", "goodness": "good", "sensibly": "sensibl", "quickly": "quick", "replacement": "replac",
}
MORE_FRENCH = {
    "parler": "parl", "parlaient": "parl", "finissons": "fin", "finissant": "fin", "chevaux": "cheval", "gâteaux": "gâteau", "nationale": "national", "fréquemment": "fréquent", "constamment": "const", "lentement": "lent", "activement": "activ",
    "heureusement": "heureux", "heureuse": "heureux", "biologie": "biolog", "solution": "solut", "révolution": "révolu", "présence": "présenc", "capacité": "capac", "électricité": "électr", "activité": "activ", "possible": "possibl", "qualité": "qualit", "quand": "quand",
    "premier": "premi", "première": "premi", "jeunes": "jeun", "aimée": "aim", "royale": "royal", "voyage": "voyag", "naïve": "naïv", "ouvrir": "ouvr", "tapis": "tapis", "collection": "collect", "française": "français", "ancienne": "ancien",
}


@pytest.mark.parametrize(("stem", "pairs"), [(stemmers.english, ENGLISH), (stemmers.french, FRENCH)])
def test_published_samples(stem, pairs):
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


@pytest.mark.parametrize(("stem", "words"), [(stemmers.english, MORE_ENGLISH), (stemmers.french, MORE_FRENCH)])
def test_single_rules(stem, words):
    assert {w: stem(w) for w in words} == words


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeilnorstuyé", max_size=14))
def test_stems_of_any_words(word):
    plain = str.maketrans("éy", "ei")
    for stem in (stemmers.english, stemmers.french):
        got = stem(word)
        assert len(got) <= len(word) + 1 and got == got.lower() and got[:2].translate(plain) == word[:2].translate(plain)[: len(got)]


def test_words_without_letters():
    for stem in (stemmers.english, stemmers.french):
        assert [stem(w) for w in ("", "1", "2024", "日本")] == ["", "1", "2024", "日本"]
