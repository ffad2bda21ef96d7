"""Stemmers for German, French and Spanish after the published Snowball descriptions.

Regions: R1 begins behind the first non-vowel that follows a vowel, R2 is the same
within R1, RV is defined by each language. Suffixes are sought longest first.
"""

from __future__ import annotations

from functools import lru_cache


def _after(w: str, start: int, vowels: str) -> int:
    """Behind the first non-vowel that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _longest(w: str, endings, start: int = 0) -> str:
    """The longest of the endings that stands at the end of w, from ``start`` on; "" if none does."""
    return max((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


def _cut(w: str, end: str, start: int) -> str:
    """w without the ending, if it stands in the region."""
    return w[: -len(end)] if w.endswith(end) and len(w) - len(end) >= start else w


# German

GERMAN = "aeiouyäöü"


@lru_cache(maxsize=100_000)
def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in GERMAN and w[i + 1] in GERMAN else c for i, c in enumerate(w))
    first = _after(w, 0, GERMAN)
    r1, r2 = max(first, 3), _after(w, first, GERMAN)
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(w) - len(end) >= r2:
        stem = w[: -len(end)]
        if end in ("end", "ung"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else stem
        elif end in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif end in ("lich", "heit"):
            w = _cut(stem, stem[-2:], r1) if stem.endswith(("er", "en")) else stem
        else:
            w = _cut(stem, "lich", r2) if stem.endswith("lich") else _cut(stem, "ig", r2)
    return w.lower().translate(str.maketrans("äöü", "aou"))


# Spanish

SPANISH = "aeiouáéíóúü"
PLAIN = str.maketrans("áéíóú", "aeiou")
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
E_VERBS = ("en", "es", "éis", "emos")
VERBS = (
    *(v + "r" + e for v in "aei" for e in ("ían", "ías", "án", "ás", "íais", "ía", "éis", "íamos", "emos", "á", "é")),
    *"aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split(),
)
SPANISH_GROUPS = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion",
    "log": "logía logías", "u": "ución uciones ucion", "ente": "encia encias", "amente": "amente", "mente": "mente", "idad": "idad idades", "iva": "iva ivo ivas ivos",
}
SPANISH_SUFFIXES = {e: k for k, v in SPANISH_GROUPS.items() for e in v.split()}


def _spanish_rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in SPANISH:
        return next((i + 1 for i in range(2, len(w)) if w[i] in SPANISH), len(w))
    if w[0] in SPANISH:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in SPANISH), len(w))
    return 3


def _spanish_suffix(w: str, r1: int, r2: int) -> str:
    end = _longest(w, SPANISH_SUFFIXES)
    if not end:
        return w
    kind = SPANISH_SUFFIXES[end]
    if len(w) - len(end) < (r1 if kind == "amente" else r2):
        return w
    stem = w[: -len(end)]
    if kind in ("log", "u", "ente"):
        return stem + kind
    more = {"ic": ("ic",), "amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iva": ("at",)}.get(kind, ())
    before = _longest(stem, more)
    if before:
        stem = _cut(stem, before, r2)
        if kind == "amente" and before == "iv":
            stem = _cut(stem, "at", r2)
    return stem


@lru_cache(maxsize=100_000)
def spanish(word: str) -> str:
    w = word
    rv, r1 = _spanish_rv(w), _after(w, 0, SPANISH)
    r2 = _after(w, r1, SPANISH)
    pronoun = _longest(w, PRONOUNS, rv)
    if pronoun:
        stem = w[: -len(pronoun)]
        accented = _longest(stem, ("iéndo", "ándo", "ár", "ér", "ír"), rv)
        if accented:
            w = stem[: -len(accented)] + accented.translate(PLAIN)
        elif _longest(stem, ("ando", "iendo", "ar", "er", "ir"), rv) or _longest(stem, ("yendo",), rv) and stem[:-5].endswith("u"):
            w = stem
    after = _spanish_suffix(w, r1, r2)
    if after == w:
        end = _longest(w, Y_VERBS, rv)
        if end and w[: -len(end)].endswith("u"):
            after = w[: -len(end)]
        else:
            end = _longest(w, (*E_VERBS, *VERBS), rv)
            if end:
                after = w[: -len(end)]
                if end in E_VERBS and after.endswith("gu"):
                    after = after[:-1]
    w = after
    end = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(PLAIN)


# French

FRENCH = "aeiouyâàëéêèïîôûù"
FRENCH_GROUPS = {
    "delete": "ance iqUe isme able iste eux ances iqUes ismes ables istes", "ateur": "atrice ateur ation atrices ateurs ations", "log": "logie logies", "u": "usion ution usions utions", "ent": "ence ences",
    "ement": "ement ements", "ité": "ité ités", "if": "if ive ifs ives", "eaux": "eaux", "aux": "aux", "euse": "euse euses", "issement": "issement issements", "amment": "amment", "emment": "emment", "ment": "ment ments",
}
FRENCH_SUFFIXES = {e: k for k, v in FRENCH_GROUPS.items() for e in v.split()}
I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
ER_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_marked(w: str) -> str:
    out = list(w)
    for i, c in enumerate(w):
        before, behind = i > 0 and out[i - 1] in FRENCH, i + 1 < len(w) and w[i + 1] in FRENCH
        if c in "ui" and before and behind or c == "y" and (before or behind) or c == "u" and i and w[i - 1] == "q":
            out[i] = c.upper()
    return "".join(out)


def _french_rv(w: str) -> int:
    if w.startswith(("par", "col", "tap")) or len(w) > 2 and w[0] in FRENCH and w[1] in FRENCH:
        return 3
    return next((i + 1 for i in range(1, len(w)) if w[i] in FRENCH), len(w))


def _or(stem: str, end: str, start: int, to: str) -> str:
    """The ending deleted in the region, replaced elsewhere."""
    return stem[: -len(end)] + ("" if len(stem) - len(end) >= start else to)


def _french_suffix(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(the word after the first step, whether the verb steps follow though it changed)."""
    end = _longest(w, FRENCH_SUFFIXES)
    if not end:
        return w, True
    kind, stem, at = FRENCH_SUFFIXES[end], w[: -len(end)], len(w) - len(end)
    if kind == "delete":
        return (stem if at >= r2 else w), False
    if kind == "ateur" and at >= r2:
        return (_or(stem, "ic", r2, "iqU") if stem.endswith("ic") else stem), False
    if kind in ("log", "u", "ent") and at >= r2:
        return stem + kind, False
    if kind == "ement" and at >= rv:
        if stem.endswith("iv"):
            after = _cut(stem, "iv", r2)
            return (_cut(after, "at", r2) if after != stem else after), False
        if stem.endswith("eus"):
            return (stem[:-3] if len(stem) - 3 >= r2 else stem[:-3] + "eux" if len(stem) - 3 >= r1 else stem), False
        if stem.endswith(("abl", "iqU")):
            return _cut(stem, stem[-3:], r2), False
        if stem.endswith(("ièr", "Ièr")):
            return (stem[:-3] + "i" if len(stem) - 3 >= rv else stem), False
        return stem, False
    if kind == "ité" and at >= r2:
        for before, to in (("abil", "abl"), ("ic", "iqU")):
            if stem.endswith(before):
                return _or(stem, before, r2, to), False
        return _cut(stem, "iv", r2), False
    if kind == "if" and at >= r2:
        after = _cut(stem, "at", r2)
        return (_or(after, "ic", r2, "iqU") if after != stem and after.endswith("ic") else after), False
    if kind == "eaux":
        return w[:-1], False
    if kind == "aux" and at >= r1:
        return stem + "al", False
    if kind == "euse" and at >= r1:
        return (stem if at >= r2 else stem + "eux"), False
    if kind == "issement" and at >= r1 and stem and stem[-1] not in FRENCH:
        return stem, False
    if kind in ("amment", "emment") and at >= rv:
        return stem + ("ant" if kind == "amment" else "ent"), True
    if kind == "ment" and at - 1 >= rv and stem[-1] in FRENCH:
        return stem, True
    return w, True


@lru_cache(maxsize=100_000)
def french(word: str) -> str:
    w = start = _french_marked(word)
    rv, r1 = _french_rv(w), _after(w, 0, FRENCH)
    r2 = _after(w, r1, FRENCH)
    w, verbs = _french_suffix(w, rv, r1, r2)
    if w == start or verbs:
        end = _longest(w, I_VERBS, rv)
        before = len(w) - len(end) - 1
        if end and before >= rv and w[before] not in FRENCH:
            w = w[: -len(end)]
        else:
            end = _longest(w, ("ions", *ER_VERBS, *A_VERBS), rv)
            if end and (end != "ions" or len(w) - 4 >= r2):
                w = w[: -len(end)]
                if end in A_VERBS:
                    w = _cut(w, "e", rv)
    if w != start:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        end = _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if end == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st" else w
        elif end:
            w = w[: -len(end)] + ("" if end == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    at = len(w)
    while at and w[at - 1] not in FRENCH:
        at -= 1
    if 0 < at < len(w) and w[at - 1] in "éè":
        w = w[: at - 1] + "e" + w[at:]
    return w.lower()
