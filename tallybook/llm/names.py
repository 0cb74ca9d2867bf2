"""Reading names of people and organisations, and deciding whether two mean the same."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from tallybook.llm.places import edits, one_edit

# Common English short and pet forms of given names, by full name.
_PET = {
    "ABIGAIL": "ABBY GAIL", "ABRAHAM": "ABE", "ADELAIDE": "ADDIE HEIDI", "AGNES": "AGGIE", "ALBERT": "AL BERT BERTIE", "ALEXANDER": "ALEX AL SANDY XANDER LEX", "ALFRED": "AL ALF FRED", "ALICE": "ALLIE",
    "AMANDA": "MANDY", "ANDREW": "ANDY DREW", "ANGELA": "ANGIE", "ANNE": "ANNIE NAN NANCY", "ANTHONY": "TONY ANT", "ARTHUR": "ART ARTIE", "AUGUSTUS": "GUS", "BARBARA": "BARB BARBIE BABS", "BARTHOLOMEW": "BART",
    "BEATRICE": "BEA TRIXIE", "BENJAMIN": "BEN BENNY BENJI", "BERNARD": "BERNIE", "BRADLEY": "BRAD", "CAROLINE": "CAROL CARRIE LINA", "CASSANDRA": "CASS SANDRA", "CATHERINE": "CATHY KATE KATIE KIT CAT", "CHARLES": "CHARLIE CHUCK CHAS CHAZ",
    "CHARLOTTE": "LOTTIE CHARLIE", "CHRISTINE": "CHRIS CHRISSY TINA", "CHRISTOPHER": "CHRIS KIT TOPHER", "CLARENCE": "CLAIR", "CLIFFORD": "CLIFF", "CYNTHIA": "CINDY", "DANIEL": "DAN DANNY", "DAVID": "DAVE DAVEY", "DEBORAH": "DEB DEBBIE DEBRA",
    "DOLORES": "LOLA DOLLY", "DONALD": "DON DONNIE", "DOROTHY": "DOT DOTTIE DOLLY DORA", "DOUGLAS": "DOUG", "EDMUND": "ED NED TED", "EDWARD": "ED EDDIE TED NED TEDDY", "EDWIN": "ED EDDIE", "ELEANOR": "ELLIE NELL NORA", "ELIZABETH": "LIZ BETH BETSY BETTY ELIZA LIZZIE LIBBY BESS",
    "EMILY": "EM EMMY", "EUGENE": "GENE", "EVELYN": "EVE EVIE", "FLORENCE": "FLO FLOSSIE", "FRANCES": "FRAN FANNY FRANKIE", "FRANCIS": "FRANK FRANKIE", "FREDERICK": "FRED FREDDY FREDDIE RICK FRITZ", "GABRIEL": "GABE", "GEOFFREY": "GEOFF JEFF",
    "GERALD": "GERRY JERRY", "GERTRUDE": "TRUDY GERTIE", "GILBERT": "GIL BERT", "GREGORY": "GREG", "GWENDOLYN": "GWEN WENDY", "HAROLD": "HARRY HAL", "HELEN": "NELL NELLIE LENA", "HENRY": "HANK HARRY HAL", "HERBERT": "HERB BERT", "HOWARD": "HOWIE",
    "ISAAC": "IKE", "ISABEL": "BELLE IZZY", "JACOB": "JAKE", "JACQUELINE": "JACKIE", "JAMES": "JIM JIMMY JAMIE", "JANET": "JAN", "JEFFREY": "JEFF", "JENNIFER": "JEN JENNY JENN", "JEREMIAH": "JERRY", "JESSICA": "JESS JESSIE", "JOHN": "JACK JOHNNY JON",
    "JONATHAN": "JON NATHAN", "JOSEPH": "JOE JOEY", "JOSEPHINE": "JO JOSIE", "JOSHUA": "JOSH", "JUDITH": "JUDY JUDE", "KATHERINE": "KATE KATIE KATHY KAT KIT KAY", "KENNETH": "KEN KENNY", "KIMBERLY": "KIM", "LAWRENCE": "LARRY LARS", "LEONARD": "LEN LENNY LEO",
    "LEROY": "ROY", "LESLIE": "LES", "LILLIAN": "LIL LILLY", "LOUIS": "LOU LOUIE", "LUCILLE": "LUCY", "MADELINE": "MADDIE LENA", "MARGARET": "MAGGIE MEG PEGGY MARGE MARGIE RITA GRETA DAISY", "MARTHA": "MATTIE PATTY", "MARTIN": "MARTY", "MARY": "MOLLY POLLY MAMIE",
    "MATILDA": "TILLY MATTIE", "MATTHEW": "MATT", "MAXIMILIAN": "MAX", "MELISSA": "MISSY LISSA", "MICHAEL": "MIKE MICK MICKEY MITCH", "MILDRED": "MILLIE", "MONTGOMERY": "MONTY", "NATHANIEL": "NATE NAT NATHAN", "NICHOLAS": "NICK NICKY", "NORMAN": "NORM", "OLIVER": "OLLIE",
    "PAMELA": "PAM PAMMY", "PATRICIA": "PAT PATTY TRISH PATSY TRICIA", "PATRICK": "PAT PADDY", "PENELOPE": "PENNY", "PETER": "PETE", "PHILIP": "PHIL", "PRISCILLA": "CILLA", "RAYMOND": "RAY", "REBECCA": "BECKY BECCA", "REGINALD": "REG REGGIE", "RICHARD": "RICK DICK RICH RICHIE",
    "ROBERT": "BOB ROB BOBBY ROBBIE BERT", "RODNEY": "ROD", "RONALD": "RON RONNIE", "ROSEMARY": "ROSE ROSIE", "RUSSELL": "RUSS RUSTY", "SAMANTHA": "SAM SAMMY", "SAMUEL": "SAM SAMMY", "SARAH": "SALLY SADIE", "STANLEY": "STAN", "STEPHANIE": "STEPH", "STEPHEN": "STEVE STEVIE STEVEN",
    "STUART": "STU", "SUSAN": "SUE SUSIE SUZY", "SYLVESTER": "SLY", "TERENCE": "TERRY", "THEODORE": "TED THEO TEDDY", "THERESA": "TERRY TESS TESSA", "THOMAS": "TOM TOMMY", "TIMOTHY": "TIM TIMMY", "VALERIE": "VAL", "VICTOR": "VIC", "VICTORIA": "VICKY TORI VICKIE", "VINCENT": "VINCE VIN VINNY",
    "VIRGINIA": "GINNY", "WALTER": "WALT WALLY", "WILLIAM": "BILL WILL BILLY WILLIE LIAM", "ZACHARY": "ZACK",
}
PET: dict[str, set[str]] = {}
for _full, _short in _PET.items():
    for _s in _short.split():
        PET.setdefault(_s, set()).add(_full)
# Legal forms and abbreviated words of organisations.
FORMS = {
    "INC": "INC", "INCORPORATED": "INC", "CORP": "CORP", "CORPORATION": "CORP", "CO": "CO", "COMPANY": "CO", "LLC": "LLC", "LTD": "LTD", "LP": "LP", "LLP": "LLP", "PAC": "PAC",
    "COMMITTEE": "CMTE", "CMTE": "CMTE", "COM": "CMTE", "COMM": "CMTE", "CTE": "CMTE", "ASSN": "ASSN", "ASSOCIATION": "ASSN", "ASSOC": "ASSN", "ASN": "ASSN", "PARTNERS": "PTNR",
    "PARTNERSHIP": "PTNR", "PTNRS": "PTNR", "PTRS": "PTNR",
}
SHORT = {
    "CMTY": "COMMUNITY", "CNTY": "COUNTY", "CO-OP": "COOP", "CTRL": "CENTRAL", "CNTRL": "CENTRAL", "ELEC": "ELECTRIC", "ENGR": "ENGINEERING", "ENG": "ENGINEERING", "HRTG": "HERITAGE",
    "INS": "INSURANCE", "MED": "MEDICAL", "REG": "REGIONAL", "RGNL": "REGIONAL", "RX": "PHARMACY", "VLY": "VALLEY", "UTD": "UNITED", "NATL": "NATIONAL", "INTL": "INTERNATIONAL",
    "MFG": "MANUFACTURING", "SVC": "SERVICE", "SVCS": "SERVICES", "BLDRS": "BUILDERS", "UNIV": "UNIVERSITY", "DEPT": "DEPARTMENT", "GOVT": "GOVERNMENT", "FDN": "FOUNDATION",
}
#: Words that mark an organisation besides its legal form.
MARKS = {"FOR", "ALLIANCE", "COALITION", "CITIZENS", "FRIENDS", "VOTERS", "FUND", "TRUST", "CHURCH", "UNION", "FOUNDATION", "BANK", "SCHOOL", "UNIVERSITY", "AGAINST", "ELECT", "PARTY", "COUNCIL", "CLUB", "LEAGUE"}
_SMALL = {"THE", "OF", "AND", "A", "AN", "TO", "DBA"}
_TITLES = {"MR", "MRS", "MS", "MISS", "DR", "HON", "REV", "PROF", "SIR", "CAPT", "COL", "SEN", "REP", "JUDGE"}
_SUFFIXES = {"JR": "JR", "SR": "SR", "II": "II", "III": "III", "IV": "IV", "JUNIOR": "JR", "SENIOR": "SR"}
_TAIL = re.compile(r"\b(ET ?AL|ET ?UX|ET ?VIR|HEIRS( OF)?|TRUSTEES?|TTEE|ESTATE( OF)?|LIFE ESTATE|ESQ|MD|PHD|CPA)\b")
_NOBODY = re.compile(r"^(AGGREGATED|UNITEMIZED|ANONYMOUS|UNKNOWN|NONE|NULL|N/?A|NOT (AVAILABLE|PROVIDED|GIVEN|KNOWN)|INFORMATION REQUESTED|REQUESTED|BEST EFFORTS|SEE (NOTE|ATTACHED)|VARIOUS|MISC|CASH|NO NAME|TBD|TEST)\b")


class Name(NamedTuple):
    """A name read: kind 'P' (person), 'O' (organisation), 'A' (initials of one) or ''."""

    kind: str
    form: str  # suffix of a person, legal form of an organisation
    readings: tuple[tuple[str, ...], ...]  # person: (first, last, middles...) per reading; organisation: its words, then its initials


NOBODY = Name("", "", ())


def clean(text: str) -> str:
    """Upper-case ASCII without points and quotes."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"\((AKA|DBA|FKA)\b[^)]*\)", " ", text.upper())
    text = re.sub(r"\b(?:[A-Z]\.){2,}", lambda m: m[0].replace(".", ""), text)
    return re.sub(r"\s+", " ", re.sub(r"[.'’`\"()]", "", text)).strip(" ,;-")


def legal_form(t: str) -> tuple[str, str]:
    """Text without its legal form, and the form."""
    t, n = re.subn(r"\bLIMITED LIABILITY (COMPANY|CO)\b|\bL L C\b", " LLC ", t)
    t, m = re.subn(r"\bPOL(ITICAL)? ACT(ION)? (COMMITTEE|CMTE|COMM?|CTE)\b|\bP A C\b", " PAC ", t)
    words = t.split()
    found = [FORMS[w] for w in words if w in FORMS]
    return " ".join(w for w in words if w not in FORMS), (found[-1] if found else "")


def org_words(t: str) -> list[str]:
    """Words of an organisation in full spelling, small words dropped."""
    return [SHORT.get(w, w) for w in re.findall(r"[A-Z0-9]+", t.replace("&", " AND ")) if w not in _SMALL]


def initials(t: str) -> tuple[str, ...]:
    """Initials of an organisation's words as typed and in full, with and without its small words (an article never counts)."""
    every = [w for w in re.findall(r"[A-Z0-9]+", t.replace("&", " AND ")) if w not in ("THE", "A", "AN", "DBA")]
    found = ["".join(SHORT.get(w, w)[0] if full else w[0] for w in every if small or w not in _SMALL) for full in (True, False) for small in (True, False)]
    return tuple(dict.fromkeys(x for x in found if len(x) > 1))


def read_name(text: str | None, org_tokens: set[str] | frozenset[str] = frozenset(), owner: bool = False) -> Name:
    """The name in a field; ``owner`` fields name a first owner before '&' or 'AND'."""
    t = clean(text or "")
    if not t or _NOBODY.match(t) or not re.search(r"[A-Z]", t):
        return NOBODY
    t = _TAIL.sub(" ", t).strip(" ,")
    core, form = legal_form(t)
    words = org_words(core)
    if form or MARKS & set(words) or re.search(r"\bFOR\b", t) or any(w in org_tokens for w in words):
        if len(words) == 1 and len(words[0]) > 1 and words[0] not in org_tokens:
            return Name("A", form, (tuple(words),))
        return Name("O", form, (tuple(words), initials(core))) if words else NOBODY
    if owner:
        t = re.split(r"\s*(?:&|;|\bAND\b|/)\s*", t)[0].strip(" ,")
    comma = "," in t
    suffix = ""
    parts = []
    for piece in t.split(","):
        ws = []
        for w in re.findall(r"[A-Z]+", piece):
            if w in _SUFFIXES:
                suffix = _SUFFIXES[w]
            elif w not in _TITLES:
                ws.append(w)
        parts.append((ws, "-" in piece))
    parts = [p for p in parts if p[0]]
    flat = [w for p, _ in parts for w in p]
    if not flat:
        return NOBODY
    if len(flat) == 1:
        return Name("A", "", ((flat[0],),)) if len(flat[0]) > 1 else NOBODY
    readings = []
    if comma and len(parts) > 1:
        last, rest = parts[0][0], [w for p, _ in parts[1:] for w in p]
        readings.append((rest[0], " ".join(last), *rest[1:]))
    else:
        pieces = re.sub(r"\s*-\s*", "-", t.replace(",", " ")).split()
        toks = [" ".join(re.findall(r"[A-Z]+", p)) for p in pieces]
        toks = [w for w in toks if w and w not in _SUFFIXES and w not in _TITLES]
        if len(toks) < 2:
            return NOBODY
        readings.append((toks[0], toks[-1], *toks[1:-1]))
        readings.append((toks[1], toks[0], *toks[2:]))
        if len(toks) > 2 and min(len(toks[-2]), len(toks[-1])) > 1:
            readings.append((toks[0], " ".join(toks[-2:]), *toks[1:-2]))
        if len(toks) > 2 and len(toks[1]) > 1:
            readings.append((toks[2], " ".join(toks[:2]), *toks[3:]))
    readings = [r for r in readings if len(r[1]) > 1]
    return Name("P", suffix, tuple(dict.fromkeys(readings))) if readings else NOBODY


_NEAR: dict[str, str] = {}
for _full in _PET:
    for _i in range(len(_full) + 1):
        _NEAR.setdefault(_full[:_i] + _full[_i + 1 :], _full)


@lru_cache(maxsize=200_000)
def fulls(first: str) -> frozenset[str]:
    """Given names a typed first name may stand for, one misspelling mended."""
    found = {first} | PET.get(first, set())
    if len(first) > 4 and len(found) == 1 and first not in _PET:
        for key in [first, *(first[:i] + first[i + 1 :] for i in range(len(first)))]:
            full = _NEAR.get(key)
            if full and one_edit(full, first):
                return frozenset(found | {full})
    return frozenset(found)


def clipped(short: str, full: str) -> bool:
    """Whether a short form is the beginning of a name (an ending -Y or -IE aside) or its end."""
    if len(full) < len(short) + 2 or len(short) < 4:
        return False
    stem = re.sub(r"(Y|IE|EY|I)$", "", short)
    doubled = len(stem) > 3 and stem[-1] == stem[-2]
    return full.startswith(short) or full.endswith(short) or (doubled and full.startswith(stem[:-1])) or (len(stem) > 3 and full.startswith(stem))


@lru_cache(maxsize=200_000)
def first_fit(a: str, b: str) -> float:
    """How well two first names agree, up to 1; -1 where they are different names."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.7 if a[0] == b[0] or any(x[0] == y[0] for x in fulls(a) for y in fulls(b)) else -1.0
    if fulls(a) & fulls(b):
        return 0.95
    if min(len(a), len(b)) >= 4 and any(one_edit(x, y) for x in fulls(a) for y in fulls(b) if min(len(x), len(y)) >= 4):
        return 0.85
    # each of the two may be misspelt once
    if a[0] == b[0] and min(len(a), len(b)) >= 6 and edits(a, b, 2) <= 2:
        return 0.8
    if any(clipped(a, x) for x in fulls(b)) or any(clipped(b, x) for x in fulls(a)):
        return 0.85
    return -1.0


@lru_cache(maxsize=200_000)
def last_fit(a: str, b: str) -> float:
    """How well two last names agree, up to 1; -1 where they are different names."""
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return 1.0
    if min(len(x), len(y)) >= 4 and one_edit(x, y):
        return 0.9
    if " " in a and " " in b:
        p, q = a.split(), b.split()
        if len(p) == len(q) and all(one_edit(u, v) for u, v in zip(p, q)):
            return 0.85
    return -1.0


class Weights:
    """Weights of tokens from counts of their q-grams: rare tokens count more."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.counts, self.total, self.known = counts, max(total, 1), {}

    def __call__(self, token: str) -> float:
        got = self.known.get(token)
        if got is None:
            grams = qgrams(token.replace(" ", ""))
            got = 0.3 + sum(math.log(1 + self.total / (1 + self.counts.get(g, 0))) for g in grams) / len(grams)
            if len(self.known) < 500_000:
                self.known[token] = got
        return got


def qgrams(token: str, q: int = 3) -> list[str]:
    """Padded q-grams of a token, each once."""
    padded = "^" * (q - 1) + token + "$" * (q - 1)
    return list(dict.fromkeys(padded[i : i + q] for i in range(len(padded) - q + 1)))


#: Least weighted similarity of two names; information, in nats, of an initial and of a suffix; share of the words' weight a legal form has.
ENOUGH, INITIAL, SUFFIX, FORM = 0.8, math.log(26), math.log(10), 0.15
#: Fits of a misspelt word, of words run together and of initials for a full name; misspelt words an organisation may have.
MISSPELT, JOINED, SPELT_OUT, MOST_MISSPELT = 0.9, 0.95, 0.9, 2


def person_likeness(a: Name, b: Name, weight: Callable[[str], float]) -> float:
    """Best weighted similarity over the readings: fitting tokens count for, contradicting ones (fit -1) against, left-out ones not at all."""
    best = -1.0
    for x in a.readings:
        for y in b.readings:
            last = last_fit(x[1], y[1])
            wl = weight(max(x[1], y[1], key=len))
            if last < 0 and best >= 0:
                continue
            first, short = first_fit(x[0], y[0]), min(len(x[0]), len(y[0])) == 1
            wf = weight(max(x[0], y[0], key=len)) * (0.5 if short and first > 0 else 1.0)
            got, all_ = wl * last + wf * first, wl + wf
            # a middle name may be left out or cut to its initial
            for m, n in zip(x[2:], y[2:]):
                initial = min(len(m), len(n)) == 1
                w = INITIAL if initial else max(weight(m), INITIAL)
                got, all_ = got + (w if (m[0] == n[0] if initial else one_edit(m, n)) else -w), all_ + w
            if a.form and b.form:
                got, all_ = got + (SUFFIX if a.form == b.form else -SUFFIX), all_ + SUFFIX
            best = max(best, got / all_)
    return best


def org_likeness(a: Name, b: Name, weight: Callable[[str], float]) -> float:
    """Soft weighted similarity of the words in any order: fitting words count for, words without a like against; so does another legal form."""
    x, y = list(a.readings[0]), list(b.readings[0])
    all_ = sum(map(weight, x)) + sum(map(weight, y))
    if a.kind != b.kind:
        word, spelt = (x[0], b) if a.kind == "A" else (y[0], a)
        got = SPELT_OUT if len(spelt.readings) > 1 and word in spelt.readings[1] else -1.0
    elif x != y and "".join(x) == "".join(y):
        got = JOINED
    else:
        left, rest, fits, misspelt = list(y), [], 0.0, 0
        for w in x:
            if w in left:
                left.remove(w)
                fits += 2 * weight(w)
            else:
                rest.append(w)
        alone = sum(map(weight, left)) + sum(map(weight, rest))
        for w in rest if a.kind == "O" else ():
            mate = next((v for v in left if min(len(w), len(v)) >= 4 and one_edit(w, v)), None)
            if mate is not None and misspelt < MOST_MISSPELT:
                left.remove(mate)
                misspelt += 1
                alone -= weight(w) + weight(mate)
                fits += MISSPELT * (weight(w) + weight(mate))
        got = (fits - alone) / all_ if all_ else -1.0
    return (got - FORM) / (1 + FORM) if a.form and b.form and a.form != b.form else got


def likeness(a: Name, b: Name, weight: Callable[[str], float]) -> float:
    """Weighted similarity of two names of one kind, -1 to 1."""
    if a.kind == "P" and b.kind == "P":
        return person_likeness(a, b, weight)
    if a.kind in ("O", "A") and b.kind in ("O", "A"):
        return org_likeness(a, b, weight)
    return -1.0
