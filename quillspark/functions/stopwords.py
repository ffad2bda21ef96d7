"""Stop words of the snowball lists (public domain) of four languages, and a small registry.

Inflected forms are built from stems and endings.
"""

# Fixed values.
ENGLISH = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing would should could ought i'm you're he's she's it's we're they're
i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't
shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very""".split()


def _forms(stems: str, endings: str) -> list[str]:
    """Every stem with every ending; "-" is the bare stem."""
    return [a + b.strip("-") for a in stems.split() for b in endings.split()]


GERMAN = """aber als also am an auch auf aus bei bin bis bist da damit dann daß dazu denn derer dessen dich dir du doch dort durch einmal er ihn ihm es etwas für gegen gewesen hab habe haben hat hatte hatten hier hin hinter
ich mich mir euch im in indem ins ist jetzt kann können könnte machen man mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr selbst sich sie ihnen sind so soll sollte sondern sonst über um und uns unter viel vom von vor
während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen der die das den dem des derselbe derselben denselben desselben demselben dieselbe
dieselben dasselbe euer eure eurem euren eurer eures ander anderm andern anderr anders""".split()
GERMAN += _forms("dein dies ein einig ihr kein mein sein", "- e em en er es") + _forms("all ander jed jen manch solch welch", "e em en er es") + _forms("uns", "e em en er es")

_FR_LATER = "ai as a ons ez ont ais ait ions iez aient"
_FR_PAST = "ais ait ions iez aient"
FRENCH = """au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y
suis es est sommes êtes sont fus fut fûmes fûtes furent fût sois soit soyons soyez soient ai as avons avez ont eut eûmes eûtes eurent eût aie aies ait ayons ayez aient étant ayant ceci cela celà cet cette ici ils les leurs quel quels quelle
quelles sans soi""".split()
FRENCH += _forms("été eu", "- e es s") + _forms("ser aur", _FR_LATER) + _forms("ét av", _FR_PAST) + _forms("fuss euss", "e es ions iez ent")

_ES_LATER = "é ás á emos éis án ía ías íamos íais ían"
_ES_PAST = "iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"
SPANISH = """de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso
ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os esos esas
estoy estás está estamos estáis están esté estés estemos estéis estén estando estad he has ha hemos habéis han habiendo soy eres es somos sois son siendo fui fuiste fue fuimos fuisteis fueron era eras éramos erais eran sido tengo tienes tiene
tenemos tenéis tienen teniendo tened estábamos""".split()
SPANISH += _forms("mí tuy suy nuestr vuestr", "o a os as") + _forms("estad habid tenid", "o a os as") + _forms("estar habr ser tendr", _ES_LATER) + _forms("estuv hub tuv", "e iste o imos isteis ieron " + _ES_PAST)
SPANISH += _forms("fu", "era eras éramos erais eran ese eses ésemos eseis esen") + _forms("hay se teng", "a as amos áis an") + _forms("hab ten", "ía ías íamos íais ían") + _forms("estab", "a as ais an")

SOURCES: dict[tuple[str, str], list[str]] = {(k, "snowball"): list(dict.fromkeys(v)) for k, v in (("en", ENGLISH), ("de", GERMAN), ("fr", FRENCH), ("es", SPANISH))}


def register(language: str, source: str, words: list[str]) -> None:
    """Makes a list known under a language and a source."""
    SOURCES[language, source] = list(words)


def stopwords(language: str = "en", source: str = "snowball") -> list[str]:
    if (language, source) not in SOURCES:
        raise ValueError(f"no stop words for language {language!r} from {source!r}; register them or give custom_stopword_source")
    return SOURCES[language, source]
