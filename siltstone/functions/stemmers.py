"""Word stems of English and French by the published Snowball rules.

A stemmer takes one lower-case word; analysers call it once for each distinct
word of a batch. Both algorithms cut endings only inside regions of the word: R1
begins behind the first consonant that follows a vowel, R2 is R1's own R1, and
French also has RV. Endings and exceptions are fixed values of the algorithms.
"""

from __future__ import annotations

import re
from collections.abc import Callable


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region behind the first consonant after a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


# English (Porter2). Fixed values, as published.
_E_VOWELS = "aeiouy"
_E_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_E_KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
_E_KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_E_R1_AFTER = ("gener", "commun", "arsen")
_E_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_E_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_E_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_E_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_E_BEFORE_LI = "cdeghkmnrt"

_SHORT_END = re.compile(f"(?:[^{_E_VOWELS}][{_E_VOWELS}][^{_E_VOWELS}wxY]|^[{_E_VOWELS}][^{_E_VOWELS}])$")
_HAS_VOWEL = re.compile(f"[{_E_VOWELS}]")


def _english_ending(word: str, r1: int) -> str:
    """Step 1b: past and progressive forms."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    stem = word[: -len(end)]
    if end in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else word
    if not _HAS_VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_E_DOUBLES):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _SHORT_END.search(stem) else stem


def english(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _E_WHOLE or word in _E_KEPT:
        return _E_WHOLE.get(word, word)
    word = word.removeprefix("'")
    word = re.sub(f"(^|[{_E_VOWELS}])y", r"\1Y", word)  # a y that is a consonant
    first = next((p for p in _E_R1_AFTER if word.startswith(p)), None)
    r1 = len(first) if first else _region(word, _E_VOWELS)
    r2 = _region(word, _E_VOWELS, r1)
    word = re.sub("'(?:s'?)?$", "", word)
    # Step 1a: plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _E_KEPT_AFTER_PLURAL:
        return word
    word = _english_ending(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _E_VOWELS:
        word = word[:-1] + "i"
    # Steps 2 and 3: endings made of several, inside R1.
    end = _longest(word, tuple(_E_STEP2))
    if end and len(word) - len(end) >= r1:
        stem = word[: -len(end)]
        if not (end == "ogi" and not stem.endswith("l")) and not (end == "li" and stem[-1:] not in tuple(_E_BEFORE_LI)):
            word = stem + _E_STEP2[end]
    end = _longest(word, tuple(_E_STEP3))
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _E_STEP3[end]
    # Step 4: endings inside R2; step 5: a last e or l.
    end = _longest(word, _E_STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    last = len(word) - 1
    if word.endswith("e") and (last >= r2 or (last >= r1 and not _SHORT_END.search(word[:-1]))) or word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# French. Fixed values, as published; letters that are consonants for the rules are upper case.
_F_VOWELS = "aeiouyâàëéêèïîôûù"
_F_RV_AFTER = ("par", "col", "tap")
_F_STEP1 = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(),
    "agent": "atrice ateur ation atrices ateurs ations".split(),
    "log": "logie logies".split(),
    "u": "usion ution usions utions".split(),
    "ent": "ence ences".split(),
    "ement": "ement ements".split(),
    "ity": "ité ités".split(),
    "ive": "if ive ifs ives".split(),
    "eau": ["eaux"],
    "al": ["aux"],
    "euse": "euse euses".split(),
    "issement": "issement issements".split(),
    "amment": ["amment"],
    "emment": ["emment"],
    "ment": "ment ments".split(),
}
_F_KIND = {e: kind for kind, endings in _F_STEP1.items() for e in endings}
_F_VERBS_I = tuple("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
_F_VERBS_E = tuple("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split())
_F_VERBS_A = tuple("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())


class _French:
    """One word on its way through the steps."""

    def __init__(self, word: str):
        v = _F_VOWELS
        word = word.replace("ë", "He").replace("ï", "Hi")
        word = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
        word = re.sub(f"y(?=[{v}])|(?<=[{v}])y", "Y", word)
        self.word = word = word.replace("qu", "qU")
        if re.match(f"[{v}][{v}]", word):
            self.rv = min(3, len(word))
        elif word.startswith(_F_RV_AFTER):
            self.rv = 3
        else:
            found = re.compile(f"[{v}]").search(word, 1)
            self.rv = found.end() if found else len(word)
        self.r1 = _region(word, v)
        self.r2 = _region(word, v, self.r1)

    def cut(self, end: str, region: int, to: str = "") -> bool:
        """Replace an ending if the word has it inside the region."""
        if self.word.endswith(end) and len(self.word) - len(end) >= region:
            self.word = self.word[: len(self.word) - len(end)] + to
            return True
        return False

    def standard(self) -> bool:
        """Step 1: nouns, adjectives and adverbs. Whether an ending went that lets no verb ending be looked for."""
        end = _longest(self.word, tuple(_F_KIND))
        kind = _F_KIND.get(end or "")
        if kind == "plain":
            return self.cut(end, self.r2)
        if kind == "agent":
            done = self.cut(end, self.r2)
            if done and self.word.endswith("ic"):
                self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
            return done
        if kind in ("log", "u", "ent"):
            return self.cut(end, self.r2, kind)
        if kind == "ement":
            return self.adverb(end)
        if kind == "ity":
            done = self.cut(end, self.r2)
            if done and self.word.endswith("abil"):
                self.cut("abil", self.r2) or self.cut("abil", 0, "abl")
            elif done and self.word.endswith("ic"):
                self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
            elif done:
                self.cut("iv", self.r2)
            return done
        if kind == "ive":
            done = self.cut(end, self.r2)
            if done and self.cut("at", self.r2) and self.word.endswith("ic"):
                self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
            return done
        if kind == "eau":
            return self.cut(end, 0, "eau")
        if kind == "al":
            return self.cut(end, self.r1, "al")
        if kind == "euse":
            return self.cut(end, self.r2) or self.cut(end, self.r1, "eux")
        if kind == "issement":
            before = self.word[: -len(end)][-1:]
            return bool(before) and before not in _F_VOWELS and self.cut(end, self.r1)
        if kind in ("amment", "emment"):
            self.cut(end, self.rv, "ant" if kind == "amment" else "ent")
        elif kind == "ment":
            at = len(self.word) - len(end) - 1
            if at >= self.rv and self.word[at] in _F_VOWELS:
                self.cut(end, 0)
        return False

    def adverb(self, end: str) -> bool:
        if not self.cut(end, self.rv):
            return False
        if self.word.endswith("iv"):
            if self.cut("iv", self.r2):
                self.cut("at", self.r2)
        elif self.word.endswith("eus"):
            self.cut("eus", self.r2) or self.cut("eus", self.r1, "eux")
        elif self.word.endswith(("abl", "iqU")):
            self.cut(self.word[-3:], self.r2)
        elif self.word.endswith(("ièr", "Ièr")):
            self.cut(self.word[-3:], self.rv, "i")
        return True

    def verb(self) -> None:
        """Step 2: verb endings, inside RV."""
        tail = self.word[self.rv :]
        end = _longest(tail, _F_VERBS_I)
        if end:
            before = tail[: -len(end)][-1:]
            if before and before not in _F_VOWELS + "H":
                self.word = self.word[: -len(end)]
                return
        end = _longest(tail, (*_F_VERBS_E, *_F_VERBS_A, "ions"))
        if end == "ions":
            self.cut(end, self.r2)
        elif end in _F_VERBS_E:
            self.cut(end, self.rv)
        elif end and self.cut(end, self.rv):
            self.cut("e", self.rv)

    def residual(self) -> None:
        """Step 4: what is left of other endings."""
        if self.word.endswith("s") and (self.word[:-1].endswith("Hi") or (len(self.word) > 1 and self.word[-2] not in "aiouès")):
            self.word = self.word[:-1]
        tail = self.word[self.rv :]
        end = _longest(tail, ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if end == "ion":
            if tail[:-3].endswith(("s", "t")):
                self.cut(end, self.r2)
        elif end == "e":
            self.cut(end, self.rv)
        elif end:
            self.cut(end, self.rv, "i")


def french(word: str) -> str:
    """The Snowball stem of a lower-case French word."""
    w = _French(word)
    before = w.word
    if not w.standard():
        w.verb()
    if w.word != before:
        if w.word.endswith("Y"):
            w.word = w.word[:-1] + "i"
        elif w.word.endswith("ç"):
            w.word = w.word[:-1] + "c"
    else:
        w.residual()
    if w.word.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.word = w.word[:-1]
    w.word = re.sub(f"[éè](?=[^{_F_VOWELS}]+$)", "e", w.word)
    return w.word.replace("He", "ë").replace("Hi", "ï").replace("H", "").lower()


#: Each analyser's stemmer; ``simple`` leaves words as they are.
STEMMERS: dict[str, Callable[[str], str] | None] = {"simple": None, "english": english, "french": french}
