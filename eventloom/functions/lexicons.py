"""Word lists, patterns and orders that results depend on. Every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stopwords, question words and words that never name an event
STOPWORDS = """a an and are as at be been being by for from had has have in into is it its of on or that the their this
to was were with""".split()
QUESTION_WORDS = "as how what when where which who why".split()
NON_EVENT_WORDS = """according afp ani author day figure list monday month more read recently reported reports reuters said
says source summary sunday thursday today tuesday update wednesday week year yesterday""".split()
# Verbs and nouns that trigger an event
EVENT_VERBS = """accuse acknowledge agree announce approve attack ban bomb call clash close condemn criticize delay
denounce deploy displace evacuate expand force halt impose increase invade kill launch meet open plan propose protest
raise reject respond resume sanction strike support threaten transfer urge visit warn worsen withdraw""".split()
EVENT_NOUNS = """attack bombing ceasefire condemnation conflict crisis displacement evacuation invasion plan proposal
protest rejection response sanction strike visit warning war""".split()
# Markers of cause, for scored pairs and for neighbouring events
COARSE_MARKERS = "after because cause caused causing following led prompted resulted sparked triggered".split()
LOCAL_MARKERS = "after because caused causing driving following led prompted sparked triggered".split()
# Stems that make a relation escalate or mitigate
ESCALATION = "attack bomb condemn criticize denounce deploy escalat kill protest sanction strike warn withdraw".split()
MITIGATION = "aid ceasefire deescalat evacuate mediate negotiat open pause rescue support talk truce".split()
# Words of a source, words of a target, and the event supposed between them
BRIDGES = [
    ("raise cut ban sanction approve vote".split(), "delay drop expand protest respond".split(), "conditions around {participants} shifted"),
    ("attack strike deploy".split(), "warn evacuate respond".split(), "security pressure around {participants} intensified"),
]
# Phrases that make an event text generic
GENERIC_PHRASES = [
    "tensions rise", "tension rises", "situation worsens", "situation deteriorates", "further developments occur",
    "events unfold", "things get worse", "conflict continues", "relations worsen",
]
# Relation ids, and the order in which labels of one pair win
RELATIONS = ["precedes", "causes", "escalates", "mitigates"]
PAIR_LABELS = ["none", *RELATIONS]
PRIORITY = {"causes": 4, "escalates": 3, "mitigates": 2, "precedes": 1}
# patterns
TOKEN = "[A-Za-z0-9']+"
CLAUSE_BREAK = r"(?i)\s*(?:,?\s+(?:and|but|while|after|because|since|as|which|who|that)\s+|[;:])\s*"
TITLE_CASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"


@dataclass(frozen=True)
class Lexicon:
    stopwords: list[str] = field(default_factory=lambda: STOPWORDS)
    non_event: list[str] = field(default_factory=lambda: STOPWORDS + QUESTION_WORDS + NON_EVENT_WORDS)
    verbs: list[str] = field(default_factory=lambda: EVENT_VERBS)
    nouns: list[str] = field(default_factory=lambda: EVENT_NOUNS)
    markers: list[str] = field(default_factory=lambda: COARSE_MARKERS)
    escalation: list[str] = field(default_factory=lambda: ESCALATION)
    mitigation: list[str] = field(default_factory=lambda: MITIGATION)


DEFAULT = Lexicon()
