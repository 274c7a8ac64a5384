"""Reading names typed by people: surname, given names, suffix; organisations apart."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from kinsieve.functions.rules import NICKNAME_GROUPS
from kinsieve.llm.edit import typo_distance

# Short forms in common use that the table shared with the other operators lacks, by formal name.
DIMINUTIVES = {
    "abigail": ["abby", "gail"],
    "adelaide": ["addie"],
    "albert": ["al", "bert", "bertie"],
    "alexander": ["alec", "sandy", "xander"],
    "alexandra": ["alex", "lexi", "sandra", "sandy"],
    "alfred": ["al", "alf", "fred"],
    "amanda": ["mandy"],
    "andrew": ["andie"],
    "anthony": ["toni"],
    "arthur": ["art", "artie"],
    "augustus": ["gus"],
    "barbara": ["babs", "barbie"],
    "beatrice": ["bea", "trixie"],
    "benjamin": ["benji"],
    "bernard": ["bernie"],
    "bradley": ["brad"],
    "brigitte": ["gitte"],
    "camila": ["cami", "mila"],
    "caroline": ["carol", "carrie"],
    "catherine": ["cat", "kath", "kit", "kitty"],
    "cecilia": ["cece"],
    "charles": ["charley", "chas"],
    "christine": ["chrissy", "christy"],
    "christopher": ["kit", "topher"],
    "clifford": ["cliff"],
    "cynthia": ["cyndi"],
    "daniel": ["dani"],
    "david": ["davey", "davy"],
    "deborah": ["debby"],
    "dominic": ["dom", "nic"],
    "donald": ["donnie", "donny"],
    "dorothy": ["dolly", "dottie"],
    "douglas": ["dougie"],
    "edith": ["edie"],
    "edward": ["ned", "teddie"],
    "eleanor": ["ellie", "nell", "nora"],
    "elizabeth": ["bess", "betsy", "elsie", "libby", "lisa"],
    "emanuel": ["manny"],
    "eugene": ["gene"],
    "florence": ["flo"],
    "frances": ["fran", "frankie", "franny"],
    "francis": ["fran", "frank", "frankie"],
    "frederick": ["freddie", "fritz"],
    "gabriel": ["gabe"],
    "gerald": ["gerry"],
    "gregory": ["gregg"],
    "gwendolyn": ["gwen"],
    "harold": ["hal", "harry"],
    "henry": ["hal", "hank", "harry"],
    "herbert": ["bert", "herb"],
    "isabella": ["bella", "izzy"],
    "jacob": ["jake"],
    "jacqueline": ["jackie"],
    "james": ["jamey", "jem"],
    "jeffrey": ["geoff"],
    "jennifer": ["jenn", "jenna"],
    "john": ["jack", "jackie", "johnny"],
    "jonathan": ["jonny"],
    "joseph": ["jojo"],
    "josephine": ["jo", "josie"],
    "joshua": ["josh"],
    "judith": ["judi", "judy"],
    "kenneth": ["kent"],
    "lawrence": ["larrie", "laurie", "lorry"],
    "leonard": ["lenny"],
    "louis": ["lou", "louie"],
    "magdalena": ["lena", "maggie"],
    "magnus": ["gus"],
    "margaret": ["greta", "madge", "marge", "margie"],
    "martin": ["marty"],
    "matthew": ["mattie"],
    "maximilian": ["max"],
    "michael": ["mick", "mickey", "mikey"],
    "millicent": ["millie"],
    "mitchell": ["mitch"],
    "nathaniel": ["nat"],
    "nicholas": ["nicky", "nico"],
    "norman": ["norm"],
    "oliver": ["ollie"],
    "pamela": ["pammy"],
    "patricia": ["tricia", "trisha"],
    "patrick": ["paddy", "pat"],
    "penelope": ["penny"],
    "peter": ["petey"],
    "philip": ["pip"],
    "raymond": ["rayray"],
    "rebecca": ["beck"],
    "richard": ["ricky", "richie"],
    "robert": ["bert", "robin"],
    "ronald": ["ronnie"],
    "rosalind": ["ros", "roz"],
    "russell": ["russ"],
    "samantha": ["sam", "sammie"],
    "samuel": ["sammie", "sammy"],
    "sidney": ["sid"],
    "stanley": ["stan"],
    "stephen": ["stevie"],
    "susan": ["sukie", "suzie", "suzy"],
    "terence": ["terry"],
    "theodore": ["ted", "teddy"],
    "thomas": ["tommie"],
    "timothy": ["timmy"],
    "valerie": ["val"],
    "victoria": ["tory", "vicki", "vickie"],
    "vincent": ["vince", "vinny"],
    "virginia": ["ginger", "ginny"],
    "wallace": ["wally"],
    "walter": ["wally"],
    "william": ["liam", "willie"],
    "winifred": ["freddie", "winnie"],
    "zachary": ["zac", "zach", "zack"],
}


def _formal() -> dict[str, set[str]]:
    """The formal names that a name may stand for: of a group of the shared table its first member."""
    out: dict[str, set[str]] = {}
    for head, *others in NICKNAME_GROUPS:
        for n in (head, *others):
            out.setdefault(n, set()).add(head)
    for formal, short in DIMINUTIVES.items():
        out[formal] = {formal}
        for n in short:
            out.setdefault(n, set()).add(formal)
    return out


BASES = _formal()

TITLES = set("mr mrs ms miss dr hon rev prof sir sra".split())
CREDENTIALS = set("esq cpa md phd ph jd dds rn mba pe cfa ret".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "2nd": "2", "iii": "3", "3rd": "3", "iv": "4", "4th": "4"}
NOBODY = set("none na vacant anonymous unknown see statement various tbd null open".split())
# what an organisation calls itself, by the word that its spellings mean
ORG_KINDS = {
    "alliance": [],
    "association": ["assn", "assoc"],
    "bank": [],
    "brotherhood": [],
    "church": [],
    "club": [],
    "coalition": [],
    "college": [],
    "committee": ["cmte", "comm"],
    "construction": ["const", "constr"],
    "council": [],
    "federation": [],
    "foundation": ["fdn", "found"],
    "fund": [],
    "holdings": ["hldg", "hldgs", "holding"],
    "hospital": [],
    "institute": ["inst"],
    "league": [],
    "library": [],
    "manufacturing": ["manuf", "mfg"],
    "ministries": ["ministry"],
    "museum": [],
    "network": [],
    "partners": ["partner", "partnership", "ptnr", "ptnrs"],
    "school": ["schools"],
    "services": ["service", "svc", "svcs"],
    "society": [],
    "trust": [],
    "union": [],
    "university": ["univ"],
}
_KIND = {w: k for k, ws in ORG_KINDS.items() for w in (k, *ws)}
_LEGAL = set("inc incorporated llc llp lp corp corporation co company ltd".split())
_ORG = _LEGAL | set(_KIND)
# kinds that are also surnames: they count where no given name follows a comma
_LONG_KINDS = [k for k in ORG_KINDS if len(k) > 7]
_REMARK = re.compile(r"\([^)]*\)|\s+-\s+until\b.*$|\bas of\b.*$|\buntil\b.*$|\bthru\b.*$|\s-\s.*$", re.I)
_DIGIT = str.maketrans("01", "ol")
_ZERO_ONE = re.compile(r"(?<=[a-z])[01]|[01](?=[a-z]{2})")
_TOKEN = re.compile(r"[a-z]+|\d(?:nd|rd|th)")
_ASIDE = TITLES | CREDENTIALS | set(SUFFIXES) | {f"{n}{x}" for n in range(10) for x in ("nd", "rd", "th")}
# surname, given name, middle name, of letters only, as most entries are
_PLAIN = re.compile(r"\s*([a-z]+)\s*,\s*([a-z]+)(?:\s+([a-z]+)\.?)?\s*")
_TOLD = _ASIDE | _ORG | NOBODY | {"until", "thru", "of"}
UNSURE = "~"  # marks a given name that is not among the known ones


def clean(text: str | None) -> str:
    if not isinstance(text, str):
        return ""
    t = text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    if "(" in t or " - " in t or " of " in t or "until" in t or "thru" in t:
        t = _REMARK.sub(" ", t)
    if "." in t:
        t = t.replace("ph.d", "phd").replace("l.l.c", "llc")
    t = t.replace("'", "").replace("’", "")
    return _ZERO_ONE.sub(lambda m: m.group().translate(_DIGIT), t) if "0" in t or "1" in t else t


class GivenNames:
    """The given names that the corpus uses, with the one meant by a mistyped one; kinds of
    organisations likewise."""

    def __init__(self, frequent: list[str]):
        self.known = {t for t in frequent if len(t) > 2 or t in BASES} | set(BASES)
        self.known -= _ASIDE | _ORG | {"and", "the"}
        self._parts: dict[str, list[str]] = {}
        for w in sorted(set(frequent) & self.known):
            if len(w) > 3:
                for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self._parts.setdefault(s, []).append(w)
        self._memo: dict[str, str] = {}
        self._kinds: dict[str, str] = dict(_KIND)

    def meant(self, token: str) -> str | None:
        """The known name, where the token is one or is one typing error away from exactly one."""
        if token in self.known:
            return token
        if len(token) < 3:
            return None
        got = self._memo.get(token)
        if got is None:
            near = {w for s in {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))} for w in self._parts.get(s, ()) if typo_distance(token, w) <= 1}
            got = near.pop() if len(near) == 1 else ""
            if len(self._memo) < 300_000:
                self._memo[token] = got
        return got or None

    def kind(self, token: str) -> str:
        """The kind of organisation that a word means, cut off or mistyped once, or ''."""
        got = self._kinds.get(token)
        if got is None:
            got = ""
            if len(token) > 4:
                got = next((k for k in _LONG_KINDS if k[:2] == token[:2] and (len(token) > 5 and k.startswith(token) or abs(len(k) - len(token)) < 2 and typo_distance(token, k) <= 1)), "")
            if len(self._kinds) < 300_000:
                self._kinds[token] = got
        return got


def read_name(text: str | None, given: GivenNames) -> tuple[str, str, str, str, str] | None:
    """(kind, surname, first, middle, suffix), kind 'p' or 'o'; None where the entry names nobody.
    The surname is joined without blanks and hyphens. Given names are corrected, not expanded; one that
    is not known ends in UNSURE. Of an organisation, surname holds the names, first the kind of firm."""
    if isinstance(text, str) and text.isascii() and (plain := _PLAIN.fullmatch(text.lower())):
        sur, first, middle = plain.groups("")
        if _TOLD.isdisjoint((sur, first, middle, sur + first + middle)):
            return "p", sur, *_given(first, middle, given), ""
    t = clean(text)
    before, comma, after = t.partition(",")
    sur = _TOKEN.findall(before)
    giv = _TOKEN.findall(after) if comma else []
    tokens = sur + giv
    if not tokens or tokens[0] == "see" or NOBODY.issuperset(tokens) or "".join(tokens) in NOBODY:
        return None
    organisation = not _LEGAL.isdisjoint(tokens)
    if not organisation:
        kind = not _ORG.isdisjoint(tokens)
        if kind or (len(sur) > 1 and not giv and given.kind(sur[-1])):
            # a given name makes a surname of a short word: 'Church, John', 'John Bank'
            called = giv or sur
            named = (len(called[0]) == 1 or called[0] in given.known) and (bool(giv) or len(_KIND.get(sur[-1], "association")) < 8)
            organisation = not named
    if organisation:
        rest = [x for x in tokens if x not in _LEGAL and x not in ("the", "and", "of") and len(x) > 1]
        kinds = [k for x in rest[1:] if (k := given.kind(x))] or [_KIND[x] for x in rest[:1] if x in _KIND]
        core = [x for n, x in enumerate(rest) if not (given.kind(x) if n else x in _KIND)]
        return ("o", "".join(core), kinds[-1] if kinds else "", "", "") if core else None
    suffix = ""
    if not _ASIDE.isdisjoint(tokens):
        kept = []
        for n, part in enumerate((sur, giv)):
            out: list[str] = []
            for x in part:
                # a name does not begin with its suffix, but what stands behind a comma may
                if x in SUFFIXES and (out or comma):
                    suffix = suffix or SUFFIXES[x]
                elif x not in TITLES and x not in CREDENTIALS and x[0] >= "a":
                    out.append(x)
            kept.append(out)
        sur, giv = kept
    if sur and giv:
        names = giv
        # the comma may stand behind a given name that belongs to the rest
        if len(sur) > 1 and len(giv) == 1 and not given.meant(giv[0]) and all(len(x) == 1 or given.meant(x) for x in sur):
            sur, names = giv, sur
    else:
        tokens = sur or giv
        if len(tokens) < 2:
            return ("p", tokens[0], "", "", suffix) if tokens else None
        mark = [len(x) == 1 or given.meant(x) is not None for x in tokens]
        if all(mark):
            mark[-1 if not (len(tokens[-1]) == 1) else 0] = False
        sur = [x for x, m in zip(tokens, mark) if not m]
        names = [x for x, m in zip(tokens, mark) if m]
        if not names:
            # no given name is known: the last word is the surname
            sur, names = tokens[-1:], tokens[:-1]
    return "p", sur[0] if len(sur) == 1 else "".join(sur), *_given(names[0], names[1] if len(names) > 1 else "", given), suffix


def _given(first: str, middle: str, given: GivenNames) -> tuple[str, str]:
    if len(first) > 1:
        first = given.meant(first) or first + UNSURE
    if len(middle) > 1:
        middle = given.meant(middle) or middle
    return first, middle


_ONE = {n: frozenset(b) for n, b in BASES.items()}


@lru_cache(100_000)
def bases(name: str) -> frozenset[str]:
    return _ONE.get(name) or frozenset((name,))


@lru_cache(100_000)
def letters(first: str, middle: str) -> str:
    """The letters under which a name may be met: of its given name, of the formal ones it is short for,
    and of the middle name where the first is an initial. All where no given name is there."""
    if not first:
        return "abcdefghijklmnopqrstuvwxyz"
    out = {first[0], *(b[0] for b in bases(first))}
    if len(first) == 1 and middle:
        out |= {b[0] for b in bases(middle)}
    return "".join(sorted(out))
