"""Porter's stemmers: English (Porter2) after the published description, and a Russian one."""

from __future__ import annotations

import re
from functools import lru_cache

from .stem_more import french, german, spanish

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _r1(w: str, start: int = 0) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


@lru_cache(maxsize=100_000)
def english(word: str) -> str:
    w = word.replace("’", "'")
    if len(w) <= 2:
        return word
    w = w.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _r1(w)
    r2 = _r1(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eedly", "eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, to in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + to
            break
    for s, to in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


RU_VOWELS = "аеиоуыэюя"
RU_PERFECTIVE = re.compile("((?<=[ая])(?:в|вши|вшись)|ив|ивши|ившись|ыв|ывши|ывшись)$")
RU_REFLEXIVE = re.compile("(ся|сь)$")
RU_ADJECTIVE = re.compile("(ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$")
RU_PARTICIPLE = re.compile("((?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$")
RU_VERB = re.compile("((?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю)$")
RU_NOUN = re.compile("(а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$")


@lru_cache(maxsize=100_000)
def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{RU_VOWELS}]", w)
    if not m:
        return w
    head, rv = w[: m.end()], w[m.end() :]
    new = RU_PERFECTIVE.sub("", rv)
    if new == rv:
        rv = RU_REFLEXIVE.sub("", rv)
        new = RU_ADJECTIVE.sub("", rv)
        if new != rv:
            new = RU_PARTICIPLE.sub("", new)
        else:
            new = RU_VERB.sub("", rv)
            if new == rv:
                new = RU_NOUN.sub("", rv)
    rv = new.removesuffix("и")
    r2 = re.search(f"[{RU_VOWELS}][^{RU_VOWELS}].*?[{RU_VOWELS}][^{RU_VOWELS}]", head + rv)
    if r2 and re.search("ость?$", rv) and len(head + rv) - len(re.search("ость?$", rv)[0]) >= r2.end():
        rv = re.sub("ость?$", "", rv)
    rv = re.sub("(ейш|ейше)$", "", rv)
    return head + (rv[:-1] if rv.endswith(("нн", "ь")) else rv)


STEMMERS = {
    "english": english, "en": english, "porter": english, "russian": russian, "ru": russian,
    "german": german, "de": german, "french": french, "fr": french, "spanish": spanish, "es": spanish,
}
