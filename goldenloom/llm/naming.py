"""Names of persons and organisations: canonical words and the forms under which they are compared."""

from __future__ import annotations

import functools
import re
import unicodedata

# Legal forms, short and written out, in the order in which they are looked for.
LEGAL = (
    "gesellschaft mit beschrankter haftung", "gesellschaft mbh", "gesellschaft m b h", "aktiengesellschaft", "kommanditgesellschaft",
    "societe par actions simplifiee", "societe a responsabilite limitee", "societe anonyme", "sociedad de responsabilidad limitada",
    "sociedad anonima", "sociedad limitada", "besloten vennootschap", "naamloze vennootschap", "public limited company",
    "limited liability partnership", "limited liability company", "limited partnership", "limitee", "incorporated", "corporation",
    "limited", "company", "gmbh", "sarl", "inc", "corp", "llc", "llp", "ltd", "plc", "sas", "co", "ag", "kg", "sa", "sl", "bv", "nv", "mbh",
)
LEGAL_SHORT = {
    "gesellschaft mit beschrankter haftung": "gmbh", "gesellschaft mbh": "gmbh", "gesellschaft m b h": "gmbh", "aktiengesellschaft": "ag",
    "kommanditgesellschaft": "kg", "societe par actions simplifiee": "sas", "societe a responsabilite limitee": "sarl",
    "societe anonyme": "sa", "sociedad de responsabilidad limitada": "sl", "sociedad anonima": "sa", "sociedad limitada": "sl",
    "besloten vennootschap": "bv", "naamloze vennootschap": "nv", "public limited company": "plc", "limitee": "ltd",
    "limited liability partnership": "llp", "limited liability company": "llc", "limited partnership": "lp",
    "incorporated": "inc", "corporation": "corp", "limited": "ltd", "company": "co",
}
_LEGAL = re.compile(r"\b(?:" + "|".join(re.sub(" ", r"\\s+", x) for x in LEGAL) + r")\b")
# Abbreviations of the words for a trade, beside those that only cut the word off.
TRADES = {
    "sw": "software", "frt": "freight", "trdg": "trading", "mfg": "manufacturing", "pkg": "packaging", "avn": "aviation", "svcs": "services",
    "hlth": "healthcare", "inds": "industries", "intl": "international", "labs": "laboratories", "matls": "materials", "prtg": "printing",
    "ins": "insurance", "bros": "brothers", "mgmt": "management", "dist": "distribution", "svc": "services", "eng": "engineering",
    "elec": "electronics", "log": "logistics", "auto": "automotive", "bev": "beverages", "sys": "systems", "tech": "technologies",
    "med": "medical", "comp": "components", "pharma": "pharmaceuticals",
}
# Words for a trade or a branch of a firm.
TRADE_WORDS = tuple(
    "recycling instruments storage networks cosmetics paper solar construction steel engineering software ceramics supplies timber energy "
    "industries pumps foods plastics materials components transport laboratories packaging sensors services electronics analytics optics "
    "robotics trading metals systems medical catering manufacturing apparel pharmaceuticals bakery automotive dairy aviation marine "
    "healthcare tools consulting textiles water international beverages cables glass freight logistics furniture technologies seeds "
    "chemicals distribution printing".split()
)
BRANCHES = tuple("leasing pension fund capital training properties insurance brokers holding holdings ventures foundation partners".split())
TITLES = frozenset("mr mrs ms miss mme mlle m dr prof herr frau sr sra senor senora monsieur madame dipl ing".split())
NOISE = frozenset("attn the and group hq dept department und et y".split())
# Short forms of given names.
NICK = {
    "alexander": "alex sasha xander al sandy lex", "alexandra": "alex sasha sandra lexi sandy", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji",
    "charles": "charlie chuck chas charley", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "edward": "ed eddie ted ned teddy",
    "elizabeth": "liz beth betty eliza lizzie betsy libby bess", "francisco": "paco pancho fran curro kiko", "francoise": "fanchon fran", "frederic": "fred freddy", "friedrich": "fritz fred",
    "gabriella": "gaby gabi ella gabby", "guillermo": "memo guille", "hendrik": "henk rik hein", "ignacio": "nacho iggy", "isabella": "bella isa izzy", "james": "jim jimmy jamie jas", "jennifer": "jen jenny",
    "johannes": "hannes hans jan joh", "jonathan": "jon jonny nathan", "jose": "pepe chema", "josef": "sepp jupp joe", "katherine": "kate kathy katie kit kat kay", "margaret": "maggie meg peggy marge greta", "matthew": "matt matty",
    "michael": "mike mick micky mickey", "nicholas": "nick nicky nico", "patricia": "pat patty trish tricia patsy", "rebecca": "becky becca", "richard": "dick rick rich ricky richie", "robert": "bob bobby rob robbie bert",
    "samantha": "sam sammy", "samuel": "sam sammy", "stephanie": "steph stephie", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "vicky tori vic", "wilhelmina": "mina willa wilma minnie",
    "william": "bill will billy liam wm willie", "cornelis": "cor kees", "dolores": "lola loli", "lucia": "lucy luz", "pablo": "pablito", "anne": "annie", "anna": "annie ann", "chloe": "clo",
}
GIVEN = frozenset(NICK) | frozenset(
    "omar jan wei mara olga ivan oskar zoe greta priya felix stephanie amara renee tariq luc claire jurgen leila ingrid ines jean yuki sofie gunther nadia "
    "soren bjorn emil marie noor lena hugo".split()
)
_FROM_NICK: dict[str, tuple[str, ...]] = {}
for _full, _short in NICK.items():
    for _w in _short.split():
        _FROM_NICK[_w] = (*_FROM_NICK.get(_w, ()), _full)


def fold(text: str) -> str:
    text = (text or "").lower()
    if text.isascii():
        return text
    text = text.replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; more than ``most`` is most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
    return row[-1]


def bare(text: str) -> str:
    return re.sub(r"[\W_]", "", (text or "").lower())


_PREFIXES: dict[str, str] = {}
for _t in TRADE_WORDS:
    for _n in range(4, len(_t)):
        _PREFIXES[_t[:_n]] = "" if _t[:_n] in _PREFIXES else _t


def trade(word: str) -> str | None:
    """The word for a trade that ``word`` is, cuts off or abbreviates."""
    if word in _TRADE_SET:
        return word
    return TRADES.get(word) or _PREFIXES.get(word) or None


_TRADE_SET = frozenset(TRADE_WORDS)


@functools.lru_cache(100_000)
def _near_trade(word: str) -> str | None:
    """The one word for a trade or branch that ``word`` misspells."""
    if len(word) < 5:
        return None
    room = 1 if len(word) < 8 else 2
    near = [t for t in (*TRADE_WORDS, *BRANCHES) if len(t) > 4 and abs(len(t) - len(word)) <= room and osa(word, t, room) <= room]
    return near[0] if len(near) == 1 else None


def _unglue(word: str) -> tuple[str, str] | None:
    """("brolvenar", "glass") of "brolvenarglass"."""
    for t in TRADE_WORDS:
        if len(word) - len(t) >= 4 and word.endswith(t):
            return word[: -len(t)], t
    return None
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])")


class Name:
    """Canonical reading of a typed name."""

    __slots__ = ("bare", "words", "trades", "legal", "core", "given", "initials", "surname", "firm", "cut")

    def __init__(self, typed: str):
        self.bare = bare(typed)
        text = fold(_CAMEL.sub(" ", typed or ""))
        text = re.sub(r"\s-\s+accounts?\s+payable\b|\baccounts?\s+payable\b|\(hq\)|\bt/a\b.*?\bdirect\b|\bt/a\b.*$|\bc/o\b|&\s*co\b|\band\s+co\b", " ", text)
        text = re.sub(r"[’'`´](?=[a-z])", "", text)
        text = re.sub(r"[\W_]+", " ", text).strip()
        self.legal = ""
        found = _LEGAL.findall(text)
        if found:
            last = re.sub(r"\s+", " ", found[-1])
            self.legal = LEGAL_SHORT.get(last, last)
            if re.sub(r"\b(?:the)\b", "", _LEGAL.sub(" ", text)).strip():
                text = _LEGAL.sub(" ", text)
            elif len(found) > 1:  # initials that read like a legal form ("CO NV")
                text = found[0]
        words = [w for w in text.split() if w not in NOISE]
        kept = [w for w in words if w not in TITLES] or words
        self.words = kept
        self.trades, core, self.cut = [], [], False
        for w in kept:
            t = trade(w)
            self.cut |= bool(t) and t != w
            if t or w in BRANCHES:
                self.trades.append(t or w)
            else:
                core.append(w)
        if len(core) == 1 and not self.trades and (parts := _unglue(core[0])):
            core, self.trades = [parts[0]], [parts[1]]
        named = any(w in GIVEN or w in _FROM_NICK or len(w) <= 2 for w in core)
        if len(core) > 1 and (self.legal or self.trades or not named):
            for w in core[:]:
                if len(core) > 1 and (t := _near_trade(w)):
                    core.remove(w)
                    self.trades.append(t)
        self.core = core
        self.firm = bool(self.legal or self.trades)
        long = [w for w in core if len(w) > 2 or not w.isalpha()]
        self.initials = "".join(w for w in core if len(w) <= 2)
        self.given = next((w for w in long if w in GIVEN or w in _FROM_NICK), "")
        rest = list(long)
        if self.given:
            rest.remove(self.given)
        self.surname = " ".join(sorted(rest))

    def full(self) -> str:
        if self.firm:
            return "".join(sorted(self.core) + sorted(set(self.trades)))
        return "".join(sorted(w for w in self.core if len(w) > 2) or sorted(self.core))


def given_names(word: str) -> tuple[str, ...]:
    """Full given names that a short form may stand for."""
    return _FROM_NICK.get(word, ())


def room(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    r = room(min(len(a), len(b)))
    return bool(r) and osa(a, b, r) <= r


def same_given(a: str, b: str, a_initials: str = "", b_initials: str = "") -> bool:
    """Whether two given names may be one: equal, misspelt, short for the other, or an initial of it."""
    a, b = a or a_initials[:1], b or b_initials[:1]
    if not a or not b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= 2:
        return a[0] == b[0]
    if near(a, b) or b.startswith(a) or (len(a) >= 3 and len(b) > len(a) and near(a, b[: len(a)]) and a[0] == b[0]):
        return True
    full_a, full_b = {a, *given_names(a)}, {b, *given_names(b)}
    return bool(full_a & full_b) or any(near(x, y) for x in full_a for y in full_b if len(x) > 4 and len(y) > 4)


def _same_trades(a: list[str], b: list[str]) -> bool:
    x, y = set(a), set(b)
    if {w for w in x if w in BRANCHES} != {w for w in y if w in BRANCHES}:
        return False
    return x == y or x <= y or y <= x


def acronym(n: Name) -> str:
    return "".join(w[0] for w in (*n.core, *n.trades))


def same_firm(a: Name, b: Name) -> bool:
    """Whether two firm names may be one firm: core words alike, and no branch that only one of them has."""
    if not a.core or not b.core:
        return False
    x, y = "".join(sorted(a.core)), "".join(sorted(b.core))
    if near(x, y):
        return not a.trades or not b.trades or _same_trades(a.trades, b.trades)
    for s, t in ((a, b), (b, a)):
        if len(s.core) == 1 and 2 <= len(s.core[0]) <= 4 and not s.trades and sorted(s.core[0]) == sorted(acronym(t)) and len(t.core[0]) > 4:
            return True
    x, y = a.full(), b.full()
    return near(x, y) and _same_trades([w for w in a.trades if w in BRANCHES], [w for w in b.trades if w in BRANCHES])


def same_person(a: Name, b: Name) -> bool:
    if not a.surname or not b.surname:
        return False
    if near(a.surname, b.surname) or near(a.surname.replace(" ", ""), b.surname.replace(" ", "")):
        return same_given(a.given, b.given, a.initials, b.initials)
    # A given name that was not recognised stands among the surname's words.
    x, y = sorted(a.surname.split() + ([a.given] if a.given else [])), sorted(b.surname.split() + ([b.given] if b.given else []))
    if len(x) == len(y) == 2:
        for p, q in ((y[0], y[1]), (y[1], y[0])):
            if (near(x[0], p) and same_given(x[1], q)) or (near(x[1], q) and same_given(x[0], p)):
                return True
    return False


def same_name(a: Name, b: Name) -> bool:
    if a.firm == b.firm:
        return same_firm(a, b) if a.firm else same_person(a, b) or (len(a.core) == len(b.core) == 1 and near(a.core[0], b.core[0]))
    firm, other = (a, b) if a.firm else (b, a)
    return not other.given and not other.initials and same_firm(firm, other)
