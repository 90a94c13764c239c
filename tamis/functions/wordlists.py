"""Word lists and rules, as data. Every operator takes its list as an argument; these are defaults."""

from __future__ import annotations

# English stop words of the usual NLP toolkits, lower case, apostrophes included.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've now
d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't
wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Contraction rules (pattern, expansion), applied in this order to text that holds an apostrophe.
# Irregular words come first, then the regular endings. `'s` is opened only after words where it
# stands for "is": after a name it is a possessive.
CONTRACTIONS = [
    (r"(?i)\b(ca)n't\b", "$1nnot"),
    (r"(?i)\b(w)on't\b", "$1ill not"),
    (r"(?i)\b(sha)n't\b", "$1ll not"),
    (r"(?i)\bain't\b", "are not"),
    (r"(?i)\b(let)'s\b", "$1 us"),
    (r"(?i)\b(y)'all\b", "$1ou all"),
    (r"(?i)\b(ma)'am\b", "$1dam"),
    (r"(?i)\bo'clock\b", "of the clock"),
    (r"(?i)'cause\b", "because"),
    (r"(?i)'tis\b", "it is"),
    (r"(?i)'twas\b", "it was"),
    (r"(?i)\b([a-z]+)n't\b", "$1 not"),
    (r"(?i)\b(i)'m\b", "$1 am"),
    (r"(?i)\b([a-z]+)'re\b", "$1 are"),
    (r"(?i)\b([a-z]+)'ve\b", "$1 have"),
    (r"(?i)\b([a-z]+)'ll\b", "$1 will"),
    (r"(?i)\b([a-z]+)'d\b", "$1 would"),
    (
        r"(?i)\b(he|she|it|that|this|there|here|what|who|where|when|why|how|everyone|someone"
        r"|something|everything|nothing|one)'s\b",
        "$1 is",
    ),
    (r"\bTBH\b", "TO BE HONEST"),
    (r"\btbh\b", "to be honest"),
]

# Noun endings and their replacements in the WordNet morphology.
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# Mask rules by level. Each entry is a regular expression for one whole token
# (`TOKEN_RULES`) or for a stretch of text between word borders (`TEXT_RULES`).
# "strict" keeps the fused entries that a missing separator makes; "intended" separates them.
_LEANINGS_STRICT = [
    "cons", "conser", "conserv", "conservative",
    r"lib(?:eral|ertarian|center|left|right|\w{0,3})",
    r"dem(?:ocrat|ocrats|s|\w{0,3})prog", "progressive",
    "center", "centre", r" center(?:left|right)?", r"centre(?:left|right)?",
    "centrist", "centrism",
    r"moderate(?:s|ly)leftist", "lefty", r"left[-\s]?wing",
    "righty", r"right[-\s]?wing",
    r"far[-\s]?(?:left|right)", r"alt[-\s]?(?:right|left)",
    "libertarian", "centrist", "moderate", "socialist", "anarchist", "communist", "marxist",
    "repub", "republican", "republicans",
    "gop", "dnc",
]
_LEANINGS_INTENDED = [
    "cons", "conser", "conserv", "conservative",
    r"lib(?:eral|ertarian|center|left|right|\w{0,3})",
    r"dem(?:ocrat|ocrats|s|\w{0,3})", "prog", "progressive",
    r"center(?:left|right)?", r"centre(?:left|right)?",
    "centrist", "centrism",
    r"moderate(?:s|ly)", "leftist", "lefty", r"left[-\s]?wing",
    "righty", r"right[-\s]?wing",
    r"far[-\s]?(?:left|right)", r"alt[-\s]?(?:right|left)",
    "libertarian", "centrist", "moderate", "socialist", "anarchist", "communist", "marxist",
    "repub", "republican", "republicans",
    "gop", "dnc",
]
_FIGURES = """
trump donald biden joe obama barack bush george clinton bill hillary harris kamala pence mike
sanders bernie cortez alexandria ocasio-cortez aoc pelosi nancy mcconnell mitch johnson boris may
theresa sunak rishi starmer keir putin vladimir jinping xi modi narendra macron emmanuel merkel
angela trudeau justin bolsonaro jair erdogan recep tayyip morrison scott ardern jacinda
""".split()
_TOPICS = """
abortion guns immigration taxes healthcare medicare medicaid climate environment protest democracy
socialism capitalism libertarianism anarchy freedom rights marriage equality vote voting election
police crime war military maga woke libtard snowflake commie comrade sjw capitalist redneck redpill
gay trans queer immigrant soyboy cuck karen fbi fsb kgb ice cia idf
""".split()
TOKEN_RULES = {
    "strict": {1: _LEANINGS_STRICT, 2: _FIGURES, 3: _TOPICS},
    "intended": {1: _LEANINGS_INTENDED, 2: _FIGURES, 3: _TOPICS},
}

# Text rules.
_TEXT_LEANINGS = [
    "cons", "conser", "conserv", "conservative",
    "lib", "liber", "liberal", "liberter",
    "prog", "progressive",
    "leftist", "lefty", r"left[-\s]?wing",
    "righty", r"right[-\s]?wing",
    r"far[-\s]?(?:left|right)", r"alt[-\s]?(?:right|left)",
    "libertarian", "centrist", "moderate", "socialist", "anarchist", "communist", "marxist",
    "dem", "demo", "democrat", "democrats", "democratic",
    "repub", "republican", "republicans",
    "gop", "dnc",
]
_TEXT_FIGURES = [
    "(?:donald )?trump", "(?:joe )?biden", "(?:barack )?obama", r"(?:george w\. )?bush",
    "(?:bill )?clinton", "(?:hillary )?clinton", "(?:kamala )?harris", "(?:mike )?pence",
    "(?:bernie )?sanders", "(?:alexandria ocasio-)?cortez", "aoc", "(?:nancy )?pelosi",
    "(?:mitch )?mcconnell", "(?:boris )?johnson", "(?:theresa )?may", "(?:rishi )?sunak",
    "(?:keir )?starmer", "(?:vladimir )?putin", "(?:xi )?jinping", "(?:narendra )?modi",
    "(?:emmanuel )?macron", "(?:angela )?merkel", "(?:justin )?trudeau", "(?:jair )?bolsonaro",
    "(?:recep tayyip )?erdogan", "(?:scott )?morrison", "(?:jacinda )?ardern",
]
_TEXT_TOPICS_STRICT = [
    "abortion", "guns", "immigration", "taxes", "healthcare",
    "medicare", "medicaid", "climate", "environment", "protest",
    "democracy", "socialism", "capitalism", "freedom", "rights",
    "marriage", "equality", "vote", "voting", "election",
    "police", "crime", "war", "military", "maga", "woke",
    "libtard", "snowflake", "commie", "social justice warrior", "sjw",
    "redneck", "redpill", "gay", "trans", "queer", "immigrantbeta male", "soyboy", "cuck", "karen",
    "FBI", "FSB", "KGB", "ICE", "CIA", "IDF",
]
_TEXT_TOPICS_INTENDED = [
    "abortion", "guns", "immigration", "taxes", "healthcare",
    "medicare", "medicaid", "climate", "environment", "protest",
    "democracy", "socialism", "capitalism", "freedom", "rights",
    "marriage", "equality", "vote", "voting", "election",
    "police", "crime", "war", "military", "maga", "woke",
    "libtard", "snowflake", "commie", "social justice warrior", "sjw",
    "redneck", "redpill", "gay", "trans", "queer", "immigrant", "beta male", "soyboy", "cuck", "karen",
    "fbi", "fsb", "kgb", "ice", "cia", "idf",
]
TEXT_RULES = {
    "strict": {1: _TEXT_LEANINGS, 2: _TEXT_FIGURES, 3: _TEXT_TOPICS_STRICT},
    "intended": {1: _TEXT_LEANINGS, 2: _TEXT_FIGURES, 3: _TEXT_TOPICS_INTENDED},
}

# Extra text rules for links, handles and community references; off unless passed in.
LINK_RULES = [r"https?://\S+", r"www\.\S+", r"@\w+", r"/?r/\w+", r"/?u/\w+"]
