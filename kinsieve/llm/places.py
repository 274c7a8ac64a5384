"""Reading postal addresses: number, street words, unit, box, place. No abbreviation is known here;
`addresses.py` mines them."""

from __future__ import annotations

import re
import unicodedata

_ZIP = re.compile(r"(?<![\d-])(\d{5})(?:-?\d{4})?(?![\d-])")
_NO_DIGIT = re.compile(r"\D")
_BOX = re.compile(r"\b(?:p\.?\s*o\.?\s*)?(?:box|b0x)\s*#?\s*(\d+)\b|\bpob\s*#?\s*(\d+)\b|\bp\.?\s?o\.?\s+(?:b\w{1,3}\s+)?(\d+)\b")
_UNIT = re.compile(
    r"(?<![a-z])(?:apt|apartment|apartm?|unit|ste|suite|fl|floor|flr|rm|room)\.?\s*(?:#|no\.?)?\s*(\d{1,3}\s?-?[a-z]?|[a-z]\d{0,3}|[a-z]-?\d{1,3})(?![a-z0-9])|#\s*(\d{1,4}\s?-?[a-z]?|[a-z]-?\d{0,3})(?![a-z0-9])"
)
_UNIT_SIGN = re.compile(r"#|apt|apa|unit|ste|sui|fl|rm|room")
_SEGMENT = re.compile(r"[,;\n]|\s-\s")
_CARE = re.compile(r"^\s*(?:c/o|c\.o\.|attn|attention|%|care of)\b.*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"^(\d{1,6})(?:\s|$|-(?=\D))")
NO_ADDRESS = {"", "na", "none", "null", "unknown", "onfile", "seeattached", "tbd", "xxx", "notprovided", "notavailable", "same", "private", "confidential", "withheld", "various"}
_DIRECTION = re.compile(r"\b([ns])\.?\s?([ew])\b\.?|\b([nsew])\.(?=\s|$)|\bso\.")


def fold(text: str | None) -> str:
    """Lower case without accents and with single blanks."""
    if not isinstance(text, str):
        return ""
    t = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(t.lower().split())


def zip5(text: str | None) -> str:
    """The first five digits; four digits lost a leading zero."""
    d = _NO_DIGIT.sub("", text) if isinstance(text, str) else ""
    if len(d) in (4, 8):
        d = "0" + d
    return d[:5] if len(d) >= 5 else ""


def city_key(city: str | None) -> str:
    """Letters of a city's name; the mined rewrites of towns are not needed, a zip is there for most."""
    t = re.sub(r"[^a-z ]", "", fold(city))
    out = {"st": "saint", "ft": "fort", "mt": "mount", "n": "north", "s": "south", "e": "east", "w": "west", "no": "north", "so": "south"}
    return "".join(out.get(w, w) for w in t.split())


def read_address(text: str | None, zip_code: str | None = None) -> tuple[str, str, str, list[str], str] | None:
    """(zip5, number, unit, street words, rest) of a typed address, or None where it holds none. A box
    is the street word 'pobox' with its number. rest: what stood in the other segments."""
    if not isinstance(text, str) or len(text) < 16 and re.sub(r"[^a-z0-9]", "", text.lower()) in NO_ADDRESS:
        return None
    raw = text if text.isupper() or text.islower() else _CAMEL.sub(" ", text)
    z = zip_code if zip_code and len(zip_code) == 5 and zip_code.isdecimal() else zip5(zip_code)
    t = (raw if raw.isascii() else "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))).lower()
    m = None
    for m in _ZIP.finditer(t):
        pass
    if m:
        z = z or m.group(1)
        t = t[: m.start()] + ", " + t[m.end() :]
    # segments; a hyphen between blanks also parts them
    parts = [p.strip() for p in _SEGMENT.split(t)]
    parts = [p for p in parts if p and not (p[0] in "ac%" and _CARE.match(p)) and p not in ("usa", "us")]
    unit = ""
    kept = []
    for p in parts:
        b = _BOX.search(p) if "b" in p or "p" in p else None
        if b:
            number = next(g for g in b.groups() if g)
            return z, number.lstrip("0") or "0", "", ["pobox"], " ".join(kept)
        u = None if unit or not _UNIT_SIGN.search(p) else _UNIT.search(p)
        if u:
            unit = re.sub(r"[^a-z0-9]", "", next(g for g in u.groups() if g))
            p = (p[: u.start()] + " " + p[u.end() :]).strip()
        p = p.replace("#", " ").strip(" .")
        if p:
            kept.append(" ".join(p.split()))
    for n, p in enumerate(kept):
        m = _NUMBER.match(p)
        if not m:
            # the unit stood before the number, or a word of another kind did
            m2 = re.search(r"(?<![a-z0-9])(\d{1,5})\s+(?=[a-z0-9])", p)
            if not m2:
                continue
            number, street = m2.group(1), p[m2.end() :]
        else:
            number, street = m.group(1), p[m.end() :].strip(" -")
        rest = kept[:n] + kept[n + 1 :]
        if not street:
            if n + 1 >= len(kept):
                continue
            street, rest = kept[n + 1], kept[:n] + kept[n + 2 :]
        street = _DIRECTION.sub(lambda m: f" {(m.group(1) or '') + (m.group(2) or '') or m.group(3) or 's'} ", street)
        words = re.findall(r"[a-z0-9]+", street.replace("'", ""))
        if words:
            return z, number.lstrip("0") or "0", unit, words, " ".join(rest)
    return None
