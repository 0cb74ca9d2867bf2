"""Reading postal addresses into parts, with the abbreviation dictionaries of the place operator."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Postal abbreviations and spellings.
TYPES = {
    "ST": "ST", "STR": "ST", "STREET": "ST", "STRT": "ST", "AV": "AVE", "AVE": "AVE", "AVENUE": "AVE", "AVN": "AVE", "BLVD": "BLVD", "BOUL": "BLVD",
    "BOULEVARD": "BLVD", "BLV": "BLVD", "DR": "DR", "DRV": "DR", "DRIVE": "DR", "LN": "LN", "LANE": "LN", "RD": "RD", "ROAD": "RD", "CT": "CT", "CRT": "CT",
    "COURT": "CT", "CIR": "CIR", "CIRC": "CIR", "CIRCLE": "CIR", "CRCLE": "CIR", "PL": "PL", "PLACE": "PL", "PLC": "PL", "TER": "TER", "TERR": "TER",
    "TERRACE": "TER", "TRL": "TRL", "TR": "TRL", "TRAIL": "TRL", "WY": "WAY", "WAY": "WAY", "PKWY": "PKWY", "PKY": "PKWY", "PARKWAY": "PKWY", "PKW": "PKWY",
    "HWY": "HWY", "HIGHWAY": "HWY", "SQ": "SQ", "SQUARE": "SQ", "ALY": "ALY", "ALLEY": "ALY", "EXT": "EXT", "PLZ": "PLZ", "PLAZA": "PLZ", "CV": "CV", "COVE": "CV",
}
WORDS = {
    "HL": "HILL", "RN": "RUN", "MDW": "MEADOW", "MDWS": "MEADOWS", "PT": "POINT", "PNT": "POINT", "RDG": "RIDGE", "LNDG": "LANDING", "BND": "BEND", "GLN": "GLEN",
    "HOLW": "HOLLOW", "HLW": "HOLLOW", "CHPL": "CHAPEL", "CRK": "CREEK", "SPG": "SPRING", "SPGS": "SPRINGS", "JCT": "JUNCTION", "FLS": "FALLS", "MLS": "MILLS",
    "GRV": "GROVE", "STA": "STATION", "MT": "MOUNT", "FT": "FORT", "HTS": "HEIGHTS", "VLY": "VALLEY", "VW": "VIEW", "LK": "LAKE", "CTR": "CENTER", "ORCH": "ORCHARD",
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH",
    "TENTH": "10TH", "ELEVENTH": "11TH", "TWELFTH": "12TH", "THIRTEENTH": "13TH", "FOURTEENTH": "14TH", "FIFTEENTH": "15TH", "SIXTEENTH": "16TH", "SAINT": "ST",
}
DIRECTIONS = {
    "N": "N", "NO": "N", "NORTH": "N", "S": "S", "SO": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NORTHEAST": "NE", "NW": "NW",
    "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL",
    "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME",
    "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT",
    "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
    "PUERTO RICO": "PR", "GUAM": "GU", "VIRGIN ISLANDS": "VI", "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}
_CODES = set(STATES.values())
_BOX = re.compile(r"\b(?:P ?O ?BOX|POB|POST OFFICE BOX|P ?O ?B|BOX)\s*#?\s*(\d+)\b")
_UNIT = re.compile(r"(?:\b(?:APT|APARTMENT|APMT|STE|SUITE|UNIT|RM|ROOM|LOT|SPC|UNT)\b\s*#?\s*|#\s*)(\d+(?:\s?-\s?[A-Z]\b|[A-Z]\b|\s[A-Z](?=\s*(?:,|$|\d)))?|[A-Z](?:-?\d+)?\b)")
_ZIP = re.compile(r"(?<![\w-])(\d{5})(?:-?\d{4}|\s\d{4}(?=\s*(?:,|$)))?(?![\w-])")
_CARE = re.compile(r"(?:^|,)\s*(?:C/O|C O|CARE OF|ATTN|ATTENTION|ATT)\b:?[^,]*?(?=,|$|\s(?=\d+\s+[A-Z0-9])|\s(?=P ?O ?B))")
_NAME = re.compile(r"\b(" + "|".join(sorted(STATES, key=len, reverse=True)) + r")\b(?=\s*(?:,|$|\d{5}))")


class Place(NamedTuple):
    """Parts of one address; '' stands for a part left out."""

    number: str
    box: str
    unit: str
    direction: str
    street: str  # words of the street's name in canonical spelling
    kind: str
    town: str
    state: str
    zip5: str


EMPTY = Place("", "", "", "", "", "", "", "", "")


def plain(text: str) -> str:
    """Upper-case ASCII with points dropped and line breaks as commas."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"[\n\r;|]+", ",", text.upper())
    return re.sub(r"\s+", " ", re.sub(r"[.'’\"()]", "", text)).strip(" ,")


def town_name(text: str | None) -> str:
    """A town in canonical spelling."""
    return " ".join(WORDS.get(w, w) for w in re.findall(r"[A-Z]+", plain(text))) if text else ""


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter inserted, dropped, changed or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps (most + 1 if larger)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


class Gazetteer:
    """Towns by ZIP code and by name; a misspelt name finds its town by one deletion on either side."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.by_zip = dict(rows)
        self.names = {t for _, t in rows}
        self.near: dict[str, str] = {}
        for t in sorted(self.names):
            for k in self._cuts(t):
                self.near.setdefault(k, t)

    @staticmethod
    def _cuts(name: str) -> set[str]:
        flat = name.replace(" ", "")
        return {flat} | {flat[:i] + flat[i + 1 :] for i in range(len(flat))}

    def correct(self, name: str) -> str:
        """The town meant by a typed name, or the name itself."""
        if not name or name in self.names:
            return name
        for k in [name.replace(" ", ""), *sorted(self._cuts(name))]:
            t = self.near.get(k)
            if t is not None and edits(t.replace(" ", ""), name.replace(" ", ""), 2) <= (2 if len(name) > 5 else 1):
                return t
        return name

    def tail(self, tokens: list[str], known: str = "") -> int:
        """How many of the last tokens spell a town (the ``known`` one, if given)."""
        for n in (3, 2, 1):
            if len(tokens) > n or (len(tokens) == n and n < 3):
                typed = " ".join(WORDS.get(w, w) for w in tokens[-n:])
                if known:
                    if edits(typed.replace(" ", ""), known.replace(" ", ""), 2) <= (2 if len(known) > 5 else 1):
                        return n
                elif typed in self.names or (len(typed) > 5 and self.correct(typed) in self.names and self.correct(typed) != typed):
                    return n
        return 0


def read_place(text: str | None, towns: Gazetteer, city: str | None = None, state: str | None = None, zip_code: str | None = None) -> Place:
    """Parts of an address line, with the separate town fields where there are any."""
    if not text or not text.strip():
        return EMPTY
    t = plain(text)
    t = re.sub(r"[, ]+(USA|US|UNITED STATES)$", "", t)
    t = re.sub(r"^,", "", _CARE.sub(",", "," + t)).strip(" ,")
    box = unit = found_state = zip5 = ""
    if zip_code:
        z = re.sub(r"\D", "", zip_code)
        zip5 = z[:5] if len(z) in (5, 9) else ""
    t = re.sub(r"(?<=[\s,])(N|S) (E|W)(?=[\s,])", r"\1\2", t)
    if m := _BOX.search(t):
        box, t = m[1].lstrip("0"), (t[: m.start()] + "," + t[m.end() :]).strip(" ,")
    if m := _UNIT.search(t):
        unit, t = re.sub(r"[\s-]", "", m[1]), (t[: m.start()] + "," + t[m.end() :]).strip(" ,")
    structured = city is not None or state is not None or zip_code is not None
    if not structured:
        found = [m for m in _ZIP.finditer(t) if m.start() > 0 or box]
        if found:
            m = found[-1]
            zip5, t = m[1], (t[: m.start()] + " , " + t[m.end() :]).strip(" ,")
        if m := _NAME.search(t):
            found_state, t = STATES[m[1]], (t[: m.start()] + "," + t[m.end() :]).strip(" ,")
    parts = []
    for p in (x.split() for x in re.split(r"\s*,\s*", t) if x.strip()):
        # the town may stand before the house number without a break
        at = next((i for i, w in enumerate(p[:-1]) if i and w[0].isdigit() and re.fullmatch(r"\d+[A-Z]?(-\d+)?", w)), 0) if p[0].isalpha() else 0
        parts += [p[:at], p[at:]] if at else [p]
    if not structured and not found_state:
        for p in reversed(parts):
            if p[-1] in _CODES and (len(p) == 1 or not p[0][0].isdigit() or (len(p) > 2 and p[-1] not in TYPES)):
                found_state = p.pop()
                break
        parts = [p for p in parts if p]
    state_code = (state or "").strip().upper() if structured else found_state
    state_code = STATES.get(state_code, state_code)
    town = towns.correct(town_name(city)) if structured else ""
    known = towns.by_zip.get(zip5, "")
    number, street = "", []
    for p in parts:
        if not number and not box and re.fullmatch(r"\d+[A-Z]?(-\d+)?", p[0]) and len(p) > 1:
            number, street = p[0], p[1:]
        elif not town and not structured and all(w.isalpha() for w in p):
            town = " ".join(p)
    if not structured and not town and number:
        # the town follows the street without a break
        n = towns.tail(street, known) if len(street) > 1 else 0
        if not n and not known:
            cut = max((i for i, w in enumerate(street) if i and (w in TYPES or (w in DIRECTIONS and street[i - 1] in TYPES))), default=None)
            n = len(street) - 1 - cut if cut is not None else 0
        elif not n and known:
            cut = max((i for i, w in enumerate(street) if i and (w in TYPES or (w in DIRECTIONS and street[i - 1] in TYPES))), default=None)
            n = len(street) - 1 - cut if cut is not None and len(street) - 1 - cut <= 3 else 0
        if 0 < n < len(street):
            town, street = " ".join(street[-n:]), street[:-n]
    if not structured:
        town = towns.correct(town_name(town))
    if known:
        town = known
    elif town.startswith("BOX"):
        town = ""
    direction = kind = ""
    if len(street) > 1 and street[0] in DIRECTIONS:
        direction, street = DIRECTIONS[street[0]], street[1:]
    if len(street) > 1 and street[-1] in DIRECTIONS:
        direction, street = direction or DIRECTIONS[street[-1]], street[:-1]
    if len(street) > 1 and street[-1] in TYPES:
        kind, street = TYPES[street[-1]], street[:-1]
        if len(street) > 1 and street[-1] in DIRECTIONS:
            direction, street = direction or DIRECTIONS[street[-1]], street[:-1]
    name = " ".join(WORDS.get(w, w) for w in street)
    return Place(number.lstrip("0"), box, unit, direction, name, kind, town, state_code if len(state_code) == 2 else "", zip5)


#: Costs of the affine-gap alignment of an address line: opening a gap; the name's words left out, shared among them; another
#: part left out; a misspelt word; two neighbours the other way round; another word; and what two lines of one place may cost.
OPEN, NAME_GAP, PART_GAP, TYPO, SWAP, OTHER, LIMIT = 0.1, 2.0, 0.05, 0.3, 0.4, 4.0, 0.96


def word_cost(a: str, b: str) -> float:
    """Substitution cost of two words of a street's name; abbreviations of one word cost nothing."""
    if a == b or WORDS.get(a, a) == WORDS.get(b, b):
        return 0.0
    if a[0].isdigit() or b[0].isdigit():
        return OTHER
    if one_edit(a, b) and min(len(a), len(b)) > 2:
        return TYPO
    if min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) <= 1 and edits(a, b, 2) <= 2:
        return 2 * TYPO
    return OTHER


def line(place: Place) -> list[tuple[str, str]]:
    """The words of an address, each with the part it belongs to: direction, name, street type, unit."""
    words = [("N", w) for w in place.street.split()]
    return [("D", place.direction)] * bool(place.direction) + words + [("T", place.kind)] * bool(place.kind) + [("U", place.unit)] * bool(place.unit)


def token_cost(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Substitution cost of two tagged words: only like parts replace each other, and only names may be misspelt."""
    if a[0] != b[0]:
        return OTHER
    return word_cost(a[1], b[1]) if a[0] == "N" else 0.0 if a[1] == b[1] else OTHER


def align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Cost of the cheapest affine-gap alignment of two lines of tagged words."""
    if a == b:
        return 0.0
    inf = float("inf")
    rows, cols = len(a) + 1, len(b) + 1
    best = [[inf] * cols for _ in range(rows)]
    gap_a = [[inf] * cols for _ in range(rows)]
    gap_b = [[inf] * cols for _ in range(rows)]
    best[0][0] = 0.0
    # a part that both lines have is not left out; a name of one or two words does not stand without one of them, a longer one may
    left_out = [[NAME_GAP / sum(t == "N" for t, _ in side) if tag == "N" else OTHER if any(tag == t for t, _ in other) else PART_GAP for tag, _ in side] for side, other in ((a, b), (b, a))]
    for i in range(rows):
        for j in range(cols):
            here = best[i][j]
            if i:
                gap_a[i][j] = min(best[i - 1][j] + OPEN, gap_a[i - 1][j]) + left_out[0][i - 1]
            if j:
                gap_b[i][j] = min(best[i][j - 1] + OPEN, gap_b[i][j - 1]) + left_out[1][j - 1]
            if i and j:
                here = min(here, best[i - 1][j - 1] + token_cost(a[i - 1], b[j - 1]))
                # a word split in two, two words run together, two words the other way round
                if i > 1 and a[i - 2][0] == a[i - 1][0] == b[j - 1][0] == "N":
                    here = min(here, best[i - 2][j - 1] + word_cost(a[i - 2][1] + a[i - 1][1], b[j - 1][1]))
                if j > 1 and b[j - 2][0] == b[j - 1][0] == a[i - 1][0] == "N":
                    here = min(here, best[i - 1][j - 2] + word_cost(a[i - 1][1], b[j - 2][1] + b[j - 1][1]))
                if i > 1 and j > 1:
                    here = min(here, best[i - 2][j - 2] + SWAP + token_cost(a[i - 2], b[j - 1]) + token_cost(a[i - 1], b[j - 2]))
            best[i][j] = min(here, gap_a[i][j], gap_b[i][j])
    return best[-1][-1]


def same_town(a: Place, b: Place) -> bool:
    """Towns agree, or one side leaves the town out and the states do not contradict."""
    if a.zip5 and a.zip5 == b.zip5:
        return True
    if a.town and b.town:
        return edits(a.town.replace(" ", ""), b.town.replace(" ", ""), 2) <= (2 if min(len(a.town), len(b.town)) > 7 else 1)
    return not (a.state and b.state and a.state != b.state)


def same_place(a: Place, b: Place) -> bool:
    """Whether two addresses name one place: the same number or box and town, and lines that align; parts left out cost little."""
    if a.box != b.box or (not a.box and (a.number != b.number or not a.number)):
        return False
    if not same_town(a, b):
        return False
    return bool(a.box) or (bool(a.street and b.street) and align(line(a), line(b)) <= LIMIT)
