"""Personal information in free text: found by a skip-chain conditional random field, then masked.

Nodes of the field are, for each text, the words that may belong to a person's name
(labels: none, given, family) and the stretches that look like an e-mail address, a phone
number, an identity number or a street address (labels: none, that kind). Each node has a
potential: the weights of its features, its looks and the words around it. Neighbours in a
name are joined by chain edges; stretches that overlap compete by edges on which both cannot
hold; and words or values that stand again elsewhere in the text, near or far, are joined by
*skip edges* that favour one label for all of them: equal words, equal values, numbers whose
last seven digits agree. Loopy message passing gives each node's belief, so a number that is
named as a phone once is one in the signature too, and an identity number is found where it
is copied without its label. Repeats are joined one to the next, so the edges follow the
text's length. Messages pass until they stand still, ``ROUNDS`` times at most.

What a word looks like is learned: words that follow an introduction ("my name is",
"Best regards," ...) or a title, or that sign a line beside a known given name, are taken as
names, all others as none, and a softmax over hashed letter groups of the word is fitted on
them. Then the weights of the features and the tables of the edges are fitted: on ``LEARN`` of
the texts that have edges, the expectations with the introduced words held at their labels, and
the values whose own features are sure held at theirs, are raised against the free ones,
around priors set by hand. All of this sees ``sample`` texts of less than ``LONGEST`` characters at
most, those with the smallest hash of their id; the weights have a fixed size, whatever the
corpus. Towns that follow a street are counted over all texts whole (``town_table``); the model
holds them where they are ``TOWNS`` at most, else each text is joined with those of its towns
that are known. Everything else covers every text whole.

Defined results: null and empty texts have no finds; repeated rows of one id count once;
finds never overlap (the longer value wins over a name inside it); offsets are code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.arrow import map_arrow
from lakeweave.sources.tables import materialize, spread

SAMPLE = 20_000
LONGEST = 4_000
LEARN = 400
TOWNS = 200_000
ROUNDS = 30
KINDS = ("email", "phone", "id_number", "address", "person")

# --- fixed values: words that introduce, and words that belong to a kind -------------------

TITLES = frozenset("mr mrs ms miss dr prof herr frau m mme mlle sr sra srta don doña madame monsieur señor señora".split())
INTRODUCTIONS = (
    r"my name is|i am called|je m'appelle|ich hei(?:ß|ss)e|mein name ist|me llamo|mi nombre es|"
    r"(?:best|kind) regards,|regards,|cordialement,|bien à vous,|viele grüße,|mit freundlichen grüßen,|un saludo,|saludos,|"
    r"thanks to|merci à|danke an|gracias a|ask|demandez à|fragt|frag|preguntad a|pregunta a"
)
ID_WORDS = (
    r"passport|reisepass|passeport|pasaporte|ausweis\w*|personalausweis\w*|carte (?:nationale )?d.identité|cni|dni|nie|nif|ssn|social security|national insurance|nino|"
    r"s[ée]cu(?:rit[ée] sociale)?|num[ée]ro fiscal|steuer(?:-?(?:id|nummer|nr))?\w*|idnr|sozialversicherung\w*|rentenversicherung\w*|seguridad social|tax (?:id|number|no)|tax|identity card|id card|utr|nir|rvnr|svnr|nss|spi"
)
PHONE_WORDS = r"call|text me|phone|tel|tél|telefon|téléphone|teléfono|tfno|number is|nummer ist|num[ée]ro(?: est)?|número es(?: el)?|mobile|mobil|handy|cell|appelez(?:-moi)?(?: le| au)?|llamad(?:me)?(?: al)?|ruft|anruf\w*|answers on|fax|whatsapp|am besten"
OTHER_NUMBER_WORDS = r"order|bestellung|commande|pedido|article|artikel|artículo|ean|isbn|part number|part no|ratio|build|version|error|case|ticket|invoice|serial|firmware|release|page|chapter|pkg|sku|rev|model|earned|only|room"

# --- looks of the values -------------------------------------------------------------------

_AT = r"(?:@| @ |\s?[\[({<]\s?(?:at|@|arroba|arobase|ät)\s?[\])}>]\s?|&#64;|&#x40;|&commat;)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|&#46;)"
EMAIL = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9À-ɏ](?:[\wÀ-ɏ.+'-]*[\wÀ-ɏ+-])?(?:{_AT}[A-Za-z0-9À-ɏ-]+(?:{_DOT}[A-Za-z0-9À-ɏ-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])|(?: at | AT )[A-Za-z0-9-]+(?:(?: dot | DOT )[A-Za-z0-9-]+)*(?: dot | DOT )[A-Za-z]{{2,}}\b)"
)
_S = r"[ .\-/  ]"
PHONE = re.compile(
    rf"(?<![\w+#.,/-])(?:"
    rf"\(?\+\d{{1,3}}\)?(?:{_S}?\(\d{{1,4}}\))?(?:{_S}{{0,1}}\d{{1,8}}){{1,6}}|"
    rf"\(\d{{2,5}}\){_S}?\d{{2,8}}(?:{_S}\d{{2,6}}){{0,4}}(?:-\d)?|"
    rf"00\d{{2}}{_S}\d{{1,4}}(?:{_S}\d{{2,8}}){{1,4}}|"
    rf"0\d(?:{_S}\d\d){{4}}|0\d{{9,10}}|0\d{{1,4}}{_S}\d{{3,8}}(?:{_S}\d{{2,6}}){{0,2}}|"
    rf"(?:1{_S})?\d{{3}}{_S}\d{{3}}{_S}\d{{4}}|1?\d{{10}}|"
    rf"[6-9]\d\d{_S}\d{{3}}{_S}\d{{3}}|[6-9]\d\d(?:{_S}\d\d){{3}}|[6-9]\d{{8}}"
    rf")(?![\w]|[-./]\d)"
)
ID_VALUE = re.compile(r"(?<![\w+#])(?:[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Da-d](?!\w)|(?=[^\n]*\d)(?:(?!(?:ID|NR|NO|Nr|No)\b)[A-Z]{1,3}[ -]?|[a-z]{1,3}(?=[\d-]))?\d[\dA-Za-z]*(?:[ ./-]{1,1}(?=[\dA-Za-z]*\d|[A-Za-z](?![\w]))[\dA-Za-z]+)*(?!\w))")
ID_BEFORE = re.compile(rf"(?i)\b(?:{ID_WORDS})\b(?P<gap>[^\n\d.;!?]{{0,28}}(?:n[°ºo]\.? ?|nr\.? ?|no\.? ?|num\.? ?)?[^\n\d;!?]{{0,6}})$")
ID_AT = re.compile(rf"(?:{ID_WORDS})(?!\w)")
ID_SHAPES = re.compile(
    r"^(?:[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Da-d]|\d{3}[- ]?\d\d[- ]?\d{4}|[XYZxyz][- ]?\d{7}[- ]?[A-Za-z]|\d{8}[- ]?[A-Za-z]|[A-Za-z]{1,3}\d[\dA-Za-z ]{5,12}|\d{2}[A-Za-z]{2}\d{5}|"
    r"[12]( ?\d){14}|\d\d[./]\d{3}[./]\d{3}[./]\d{3}|\d\d\.\d{3}\.\d{3}[- ]?[A-Za-z]|\d\d ?\d{3} ?\d{3} ?\d{3}|\d{10,13}|\d\d[ /]?\d{10}(?:[ /]?\d\d)?|\d\d ?\d{6} ?[A-Za-z] ?\d{3}|[A-Z\d]{9})$"
)
WORD_BEFORE = re.compile(r"([^\W\d_][\w'’]*(?: [^\W\d_][\w'’]*)?)[^\w+(]{0,4}$")
PHONE_NEAR = re.compile(rf"(?i)\b(?:{PHONE_WORDS})\b[^\n\d]{{0,12}}$")
OTHER_NEAR = re.compile(rf"(?i)\b(?:{OTHER_NUMBER_WORDS})\b[^\n\d+(]{{0,10}}$")

_C = r"[A-ZÀ-ÖØ-Þ][\wà-ÿ'’-]*"
_BREAK = r"(?:,?(?: ?<br ?/?>)?\r?\n[> ]*|, ?| )"
_LINK = r"(?:de la|de los|de las|del|de l['’]|de|du|des|la|le|les|d['’]|von der|von|an der|am|im|zum|zur)"
STREETS = (
    # number first, kind of street last
    re.compile(rf"(?<![\w#./-])\d{{1,4}}[A-Za-z]?,? (?:{_C} ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Close|Court|Way|Terrace|Row|Mews|Square|Crescent|Place|Hill|Gardens|Boulevard|Blvd|St\.|St|Rd|Ave|Ln|Dr|Ct|Sq|Ter|Pl|Cl|Cres)(?!\w)"),
    # number first, kind of street after it
    re.compile(rf"(?<![\w#./-])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-Da-d]))?,? (?:rue|avenue|av\.?|bd\.?|boulevard|chemin|impasse|place|pl\.?|allée|quai|route|cours|square|passage|sentier|ruelle) (?:{_LINK} ?)?{_C}(?: (?:{_LINK} ?)?{_C}){{0,2}}", re.I & 0),
    # kind of street inside the name, number last
    re.compile(r"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]{2,}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig|pfad) \d{1,4} ?[a-z]?(?!\w)"),
    re.compile(rf"(?<![\w-])(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Beim|Unter den|Hinter der) {_C}(?: {_C})? \d{{1,4}} ?[a-z]?(?!\w)"),
    # kind of street first, number last
    re.compile(rf"(?<![\w-])(?:Calle|C/|C\.|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Glorieta|Rúa) ?(?:{_LINK} ?)?{_C}(?: (?:{_LINK} ?)?{_C}){{0,2}},? (?:n\.?º ?|núm\.? ?)?\d{{1,4}}(?: ?(?:bis|[A-D]))?(?!\w)"),
)
UNIT = re.compile(
    r"(?:,? ?(?:\r?\n[> ]*)?(?:(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Floor|App|Appt|Apt|bât|étage|Whg|Wohnung|Hinterhaus|piso|puerta|Esc)\.? ?#?\d*[A-Za-z]?\b|#\d+[A-Za-z]?\b|\d{1,2}\.? ?[ºª°](?: ?(?:[A-Za-z]{1,4}|\d)\b)?|\d{1,2}\. (?:OG|Stock|Etage)\b))+"
)
POSTAL = r"(?:[A-Z]{1,2}-)?\d{4,5}"
TOWN_WORDS = rf"{_C}(?:[ -](?:{_LINK} ?)?{_C}){{0,2}}"
AFTER_CODE = re.compile(rf"{_BREAK}{POSTAL} (?P<town>{TOWN_WORDS})")
TOWN_ONLY = re.compile(rf"{_BREAK}(?P<town>{TOWN_WORDS})")
CODE_LAST = re.compile(rf"(?:,? [A-Z]{{2}})? {POSTAL}(?!\w)")
CODE_ONLY = re.compile(rf"{_BREAK}(?:[A-Z]{{2}} )?{POSTAL}(?!\w)")
HINT = re.compile(r"\d")
# what every value of a kind holds: texts without it are not looked through with the dearer patterns
EMAIL_HINT = re.compile(r"@|&#(?:64|x40);|&commat;|[\[({<]\s?(?:at|arroba|arobase|ät)\s?[\])}>]| (?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT) ")
STREET_HINTS = (
    re.compile(r"Street|Road|Avenue|Lane|Drive|Close|Court|Way|Terrace|Row|Mews|Square|Crescent|Place|Hill|Gardens|Boulevard|Blvd|St|Rd|Ave|Ln|Dr|Ct|Sq|Ter|Pl|Cl"),
    re.compile(r"rue|avenue|av\b|bd\b|boulevard|chemin|impasse|place|pl\b|allée|quai|route|cours|square|passage|sentier"),
    re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig|pfad) \d"),
    re.compile(r"Am |An d|Im |In der |Auf de|Zum |Zur |Beim |Unter den |Hinter der "),
    re.compile(r"Calle|C/|C\.|Av|Plaza|Pza|Pl\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Glorieta|Rúa"),
)
ID_HINT = re.compile(r"\d(?:[^\n\d]{0,4}\d){4}")
PHONE_HINT = re.compile(r"\d(?:\W{0,3}\d){8}")

# --- words -----------------------------------------------------------------------------------

WORD = re.compile(r"(?<![\w&])[^\W\d_]+(?:(?:['’]|-|&#39;|&rsquo;)[^\W\d_]+)*")
GAP_NAME = re.compile(r"^(?:[  ]|&nbsp;|&#160;){1,2}$")
GAP_INITIAL = re.compile(r"^\.?(?:[  ]|&nbsp;|&#160;){0,2}$")
GAP_COMMA = re.compile(r"^,(?:[  ]|&nbsp;|&#160;){1,2}$")
GAP_TITLE = re.compile(r"^\.?(?:[  ]|&nbsp;|&#160;){1,2}$")
INTRO = re.compile(rf"(?i)(?<!\w)(?:{INTRODUCTIONS})\s")
TITLE = re.compile(r"(?<!\w)(?=(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\b\.? )")
LINE = re.compile(r"(?m)^[> ]*(?=[^\W\d_][\w'’-]+,? (?:[^\W\d_]\. )?[^\W\d_][\w'’-]+ *$)")
BITS = 15
NONE, GIVEN, FAMILY = 0, 1, 2
#: What a word of which nothing is known is worth as none.
PRIOR = 2.0
#: Below these a word is not looked at as part of a name.
GIVEN_LEAST, FAMILY_LEAST = -3.0, -4.5


def grams(word: str) -> list[int]:
    """Hashed letter groups of a word, without case."""
    w = f"<{word.casefold()}>"
    out = {w} | {w[i : i + n] for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)}
    return sorted({int.from_bytes(_fnv(g), "little") & ((1 << BITS) - 1) for g in out})


def _fnv(text: str) -> bytes:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return h.to_bytes(8, "little")


def _name_after(text: str, at: int, given: frozenset[str]) -> list[tuple[str, int]]:
    """Words with labels of the name that is introduced at ``at``."""
    words, end, titled = [], at, False
    for m in WORD.finditer(text, at, at + 90):
        gap, w = text[end : m.start()], m.group()
        if words or titled:
            comma = len(words) == 1 and bool(GAP_COMMA.match(gap))
            if not (GAP_NAME.match(gap) or (titled and not words or len(words[-1:] and words[-1][0]) == 1) and GAP_INITIAL.match(gap) or comma):
                break
        elif gap.strip():
            break
        else:
            comma = False
        end = m.end()
        if not words and w.casefold() in TITLES and w.casefold() != "don't":
            titled = True
            continue
        words.append((w, comma))
        if len([x for x in words if len(x[0]) > 1]) == 2:
            break
    full = [x for x in words if len(x[0]) > 1]
    upper = [w[:1].isupper() for w, _ in full]
    if titled and len(full) == 2 and len(words) == 2 and full[0][0].casefold() not in given and not full[1][1]:
        return [(full[0][0], FAMILY)] if upper[0] else []  # the next sentence may begin here
    if len(full) == 2 and (all(upper) or not any(upper) and not titled):
        swap = full[1][1]
        return [(full[0][0], FAMILY if swap else GIVEN), (full[1][0], GIVEN if swap else FAMILY)]
    return [(full[0][0], FAMILY)] if titled and full and upper[0] else []


class Model:
    """Weights of the letter groups, the given names and the towns: of fixed size, sent to every task once.

    Where the towns are too many for that, they are ``town_table`` and the set is empty.
    """

    def __init__(self, weights: np.ndarray, given: frozenset[str], towns: frozenset[str], town_table: DataFrame | None = None):
        self.weights, self.given, self.towns, self.town_table = weights, given, towns, town_table
        self.features = np.array(list(FEATURES.values()))
        self.tables = {k: v.copy() for k, v in TABLES.items()}
        self.cache: dict[str, tuple[float, float, float]] = {}
        self.codes = _Codes(self)

    def __getstate__(self):
        return (self.weights, self.given, self.towns, self.features, self.tables)

    def __setstate__(self, state):
        self.__init__(*state[:3])
        self.features, self.tables = state[3:]

    def word(self, word: str) -> tuple[float, float, float]:
        """Potentials (none, given, family) of a word, from its letters."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            parts = [p for p in re.split("[-'’]", word) if len(p) > 1] or [word]
            score = self.weights[grams(parts[0])].sum(0)
            for p in parts[1:]:
                score = np.minimum(score, self.weights[grams(p)].sum(0)) if len(p) > 2 else score
            # letters that say nothing leave it at the prior
            score = score + np.array([PRIOR * np.exp(score.min() - score.max()), 0.0, 0.0])
            score = np.clip(score - score.max(), -8, 0)
            score[GIVEN] = max(score[GIVEN], -1.0) if word.casefold() in self.given else score[GIVEN]
            got = self.cache[word] = tuple(float(x) for x in score)
        return got


MAY_GIVEN, MAY_FAMILY, LETTER, IS_TITLE = 1, 2, 4, 8
LIKELY = MAY_GIVEN | MAY_FAMILY
#: Codes of words in a row that may make a name.
NAME_CODES = re.compile(rb"[\x01-\x03][\x04\x0c]{0,3}[\x01-\x03]|[\x08\x0c][\x04\x0c]?[\x02\x03]")


class _Codes(dict):
    """A word's code: what part of a name it may be; kept for the next text."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = LETTER * (len(word) == 1) | IS_TITLE * (word.casefold() in TITLES)
        if not code:
            looks = self.model.word(word)
            code = MAY_GIVEN * (looks[GIVEN] > GIVEN_LEAST) | MAY_FAMILY * (looks[FAMILY] > FAMILY_LEAST)
        self[word] = int(code)
        return int(code)


def _softmax(types: list[str], label: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of the letter groups that give the words their labels."""
    rows = [grams(re.split("[-'’]", w)[0] or w) for w in types]
    flat = np.concatenate([np.array(r) for r in rows]) if rows else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights = np.zeros((1 << BITS, 3))
    m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(owner, weights[flat, k], minlength=len(types)) for k in range(3)], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - label) * weight[:, None]
        grad = np.stack([np.bincount(flat, err[owner, k], minlength=1 << BITS) for k in range(3)], 1) / 50 + 1e-3 * weights
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        weights = weights - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32)


def fit(texts: list[str], given_names: list[str], rounds: int = 120, towns: frozenset[str] | None = None) -> Model:
    """The model from texts whose introductions name people; given_names may be incomplete.

    Towns that are not given are those of the texts.
    """
    given = frozenset(g.casefold() for g in given_names if g)
    named: Counter = Counter()
    lower: Counter = Counter()
    seen: Counter = Counter()
    small: Counter = Counter()
    for t in texts:
        for w in WORD.findall(t):
            seen[w.casefold()] += 1
            small[w.casefold()] += w.islower()
        for m in INTRO.finditer(t):
            for w, label in _name_after(t, m.end(), given):
                (lower if w.islower() else named)[(w.casefold(), label)] += 1
        for m in TITLE.finditer(t):
            named.update((w.casefold(), label) for w, label in _name_after(t, m.end(), given) if not w.islower())
        for m in LINE.finditer(t):  # a signature: two words alone on a line, one of them a known given name
            pair = _name_after(t, m.end(), given)
            if any(w.casefold() in given and label == GIVEN for w, label in pair):
                named.update((w.casefold(), label) for w, label in pair)
    # a word in small letters is a name only if it was introduced with a capital too
    sure = {w for (w, _), n in named.items() if n > 0} | given
    for (w, label), n in lower.items():
        if w in sure:
            named[(w, label)] += n
    types = sorted(seen)
    index = {w: i for i, w in enumerate(types)}
    label = np.zeros((len(types), 3))
    label[:, NONE] = 1.0
    for w in index:
        g, f = named[(w, GIVEN)], named[(w, FAMILY)]
        if g + f >= 1 and (g + f) / seen[w] > 0.05:
            label[index[w]] = (0.0, g / (g + f), f / (g + f))
    for g in given:
        if g in index and label[index[g], FAMILY] < 0.5:
            label[index[g]] = (0.0, 1.0, 0.0) if named[(g, GIVEN)] else (0.5, 0.5, 0.0)
    # a word that stands with a capital only may be a name nobody introduced: it says little,
    # and nothing once the first fit takes it for a name
    named_here = label[:, NONE] < 0.9
    weight = np.where(named_here, 3.0, [1.0 if small[w] else 0.1 for w in types])
    weights = _softmax(types, label, weight, rounds)
    first = Model(weights, given, frozenset())
    weight *= [named_here[i] or small[w] > 0 or max(first.word(w)[1:]) < -1.0 for i, w in enumerate(types)]
    weights = _softmax(types, label, weight, rounds)
    learned = frozenset(w for w in index if named[(w, GIVEN)] >= 2 and label[index[w], GIVEN] > 0.8)
    if towns is None:
        told = [x for t in dict.fromkeys(texts) for x in _towns_in(t)]
        often = Counter(t for t, _ in told)
        towns = frozenset(t for t, sure in told if sure or often[t] > 1)
    model = Model(weights, given | learned, towns)
    learn(model, texts[:LEARN])
    return model


# --- candidates ------------------------------------------------------------------------------


def _streets(text: str) -> list[tuple[int, int]]:
    if not HINT.search(text):
        return []
    out = []
    for hint, rx in zip(STREET_HINTS, STREETS):
        if not hint.search(text):
            continue
        for m in rx.finditer(text):
            end = m.end()
            # the point of an abbreviation belongs to it, the end of the sentence does not
            if text[end : end + 1] == "." and re.search(r"(?:Rd|Ave|Ln|Dr|Ct|Sq|St|Blvd|Pl|Cl|Ter|Cres)$", m.group()) and re.match(r"\.(?:\.|,| ?#| (?:Apt|Flat|Unit)| ?\d{5})", text[end:]):
                end += 1
            out.append((m.start(), end))
    return out


def _after_unit(text: str, end: int) -> int:
    m = UNIT.match(text, end)
    return m.end() if m else end


def _towns_in(text: str) -> list[tuple[str, bool]]:
    """(words, sure) that stand like a town after a street, up to a closing mark or a postal code.

    A postal code beside them or a comma before them makes them sure; after a line's end or
    a blank alone a name or the next sentence may begin.
    """
    out = []
    for _, end in _streets(text):
        end = _after_unit(text, end)
        code = AFTER_CODE.match(text, end)
        m = code or TOWN_ONLY.match(text, end)
        if m:
            last = CODE_LAST.match(text, m.end())
            if last or m.end() == len(text) or text[m.end()] in ",.\r\n[<":
                out.append((m["town"], bool(code or last) or text[end : m.start("town")] in (",", ", ")))
    return out


def _town_candidates(text: str) -> set[str]:
    """Every town that an address of the text could end with."""
    out = set()
    for _, end in _streets(text):
        end = _after_unit(text, end)
        m = AFTER_CODE.match(text, end) or TOWN_ONLY.match(text, end)
        if m:
            out.update(m["town"][:e] for e in _town_ends(m["town"]))
    return out


def _whole_address(text: str, end: int, towns: Collection[str]) -> int:
    """Where an address ends that goes on after its street: unit, postal code, town."""
    end = _after_unit(text, end)
    m = AFTER_CODE.match(text, end)
    if m:
        return m.start("town") + len(_town(m["town"], towns, True))
    m = TOWN_ONLY.match(text, end)
    if m:
        town = _town(m["town"], towns, False)
        if town:
            end = m.start("town") + len(town)
            m = CODE_LAST.match(text, end)
            return m.end() if m else end
    m = CODE_ONLY.match(text, end)
    return m.end() if m else end


def _town_ends(words: str) -> list[int]:
    return [m.start() for m in re.finditer(r"[ ]", words)] + [len(words)]


def _town(words: str, towns: Collection[str], sure: bool) -> str:
    """The longest known town that the words begin with; after a postal code, else their first word."""
    ends = _town_ends(words)
    for e in reversed(ends):
        if words[:e] in towns:
            return words[:e]
    if not sure:
        return ""
    first = words[: ends[0]]
    return words[: ends[1]] if len(ends) > 1 and re.fullmatch("(?:Neu|Alt|Bad|Port|Saint|San|Santa|Los|Las|El|La|Le|Les|New|Old|North|South|East|West|Great|Little|St\\.?)", first) else first


#: Features of values and their prior weights.
FEATURES = {
    "email:plain": 6.0, "email:escaped": 6.0, "address:street": 5.0, "address:goes_on": 0.0, "id:labelled": 8.0, "id:short": 3.0, "id:copy": -1.5,
    "phone:plain": 0.0, "phone:prefix": 3.0, "phone:word": 4.0, "phone:other": -6.0, "phone:alone": 3.0, "phone:nothing": -1.0, "phone:run": -1.0,
}
_F = {name: i for i, name in enumerate(FEATURES)}


def _labelled_ids(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if len(low) != len(text):  # a letter that small writing makes two of
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in ID_AT.finditer(low):
        if m.start() and (low[m.start() - 1].isalnum() or low[m.start() - 1] == "_"):
            continue
        v = ID_VALUE.search(text, m.end(), min(len(text), m.end() + 60))
        if v and ID_BEFORE.search(text[m.start() : v.start()]):
            value = v.group()
            lead = len(value) - len(value.lstrip(" -"))
            if sum(c.isdigit() for c in value) >= 5 and ID_SHAPES.match(value.strip(" -")):
                out.append((v.start() + lead, v.end(), "id:labelled"))
            else:
                short = re.match(r"\S+", value.strip(" -"))
                if short and sum(c.isdigit() for c in short.group()) >= 6:
                    out.append((v.start() + lead, v.start() + lead + short.end(), "id:short"))
    return out


def _plain(value: str) -> str:
    return re.sub(r"[\W_]", "", value).casefold()


def candidates(text: str, towns: Collection[str]) -> list[tuple[str, int, int, tuple[str, ...]]]:
    """(kind, start, end, features) of stretches that look like a value."""
    out: list[tuple[str, int, int, tuple[str, ...]]] = []
    if EMAIL_HINT.search(text):
        out += [("email", m.start(), m.end(), ("email:plain" if "@" in m.group() else "email:escaped",)) for m in EMAIL.finditer(text)]
    if not HINT.search(text):
        return out
    for s, e in _streets(text):
        end = _whole_address(text, e, towns)
        out.append(("address", s, end, ("address:street", "address:goes_on") if end > e else ("address:street",)))
    if ID_HINT.search(text):
        ids = _labelled_ids(text)
        out += [("id_number", s, e, (f,)) for s, e, f in ids]
        # the same characters again, without a label
        for value in {text[s:e] for s, e, _ in ids}:
            for m in re.finditer(rf"(?<![\w+#]){re.escape(value)}(?!\w)", text):
                if not any(m.start() < e and s < m.end() for s, e, _ in ids):
                    out.append(("id_number", m.start(), m.end(), ("id:copy",)))
    for m in PHONE.finditer(text) if PHONE_HINT.search(text) else ():
        digits = sum(c.isdigit() for c in m.group())
        if not 9 <= digits <= 15:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        f = ["phone:plain"]
        if m.group()[0] in "+(":
            f.append("phone:prefix")
        if PHONE_NEAR.search(before):
            f.append("phone:word")
        if OTHER_NEAR.search(before):
            f.append("phone:other")
        line = text.rfind("\n", 0, m.start()) + 1
        if not re.sub(r"<[^>]*>|\[[^\]]*\]|[> \r]", "", text[line : m.start()]) and re.match(r"[ \r]*(?:\[|<|\n|$)", text[m.end() :]):
            f.append("phone:alone")
        elif "phone:word" not in f and ("phone:prefix" not in f or "phone:other" in f):
            f.append("phone:nothing")
        if re.fullmatch(r"\d{9,13}", m.group()):
            f.append("phone:run")
        out.append(("phone", m.start(), m.end(), tuple(f)))
    return out


# --- the field ---------------------------------------------------------------------------------


def propagate(potential: list[np.ndarray], edges: list[tuple[int, int, np.ndarray]], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Beliefs of all nodes by loopy message passing; potentials and edges are logarithms.

    Messages go forth over the edges in their order and back in turn, each from the newest
    beliefs; from the tenth round on they are damped, for loops that do not stand still.
    """
    belief = [[float(x) for x in p] for p in potential]
    turned = [((i, j, [[math.exp(x) for x in row] for row in t.tolist()]), (j, i, [[math.exp(x) for x in row] for row in t.T.tolist()])) for i, j, t in edges]
    sent = [[[0.0] * len(belief[j]), [0.0] * len(belief[i])] for i, j, _ in edges]
    for turn in range(rounds):
        change = 0.0
        for k in range(len(edges)) if turn % 2 == 0 else range(len(edges) - 1, -1, -1):
            for way in (0, 1):
                a, b, table = turned[k][way]
                x = [p - q for p, q in zip(belief[a], sent[k][1 - way])]
                top = max(x)
                x = [math.exp(v - top) for v in x]
                m = [math.log(max(1e-300, sum(v * row[c] for v, row in zip(x, table)))) for c in range(len(belief[b]))]
                top = max(m)
                old, new = sent[k][way], [v - top for v in m]
                if turn >= 10:
                    new = [0.5 * (p + q) for p, q in zip(new, old)]
                change = max(change, max(abs(p - q) for p, q in zip(new, old)))
                belief[b] = [v + p - q for v, p, q in zip(belief[b], new, old)]
                sent[k][way] = new
        if change < 1e-3:
            break
    return [np.array(v) for v in belief]


#: Prior tables of the edges. Chain edges are of (left label, right label): none, given, family.
TABLES = {
    "chain": np.array([[0.5, -0.5, -0.5], [-1.5, 0.5, 3.0], [-0.5, -1.0, 0.5]]),
    "comma": np.array([[0.5, 0.0, 0.0], [0.0, -1.0, -1.0], [-0.5, 3.0, -0.5]]),
    "same_word": np.array([[0.3, -0.5, -0.5], [-0.5, 1.0, -0.5], [-0.5, -0.5, 1.0]]),
    "same_value": np.array([[1.0, -1.0], [-1.0, 1.0]]),
    "overlap": np.array([[0.0, 0.0], [0.0, -12.0]]),
}
#: Of labelled copies of an identity number: stronger, for the label is sure.
COPY = 2.0


class Field:
    """The nodes and edges of a text: values first, then words by their numbers."""

    def __init__(self, text: str, model: Model, towns: Collection[str] | None = None):
        self.text = text
        self.values = candidates(text, model.towns if towns is None else towns)
        self.potential = [np.array([0.0, sum(model.features[_F[f]] for f in fs)]) for *_, fs in self.values]
        self.edges: list[tuple[int, int, str]] = []
        last: dict = {}
        order = sorted(range(len(self.values)), key=lambda i: self.values[i][1:3])
        for n, i in enumerate(order):
            kind, s, e, _ = self.values[i]
            plain = _plain(text[s:e])
            keys = ((kind, plain), (kind, plain[-7:])) if kind == "phone" else ((kind, plain),)
            self.edges += [(j, i, "same_value") for j in sorted({last[k] for k in keys if k in last})]
            last.update(dict.fromkeys(keys, i))
            for j in order[n + 1 :]:
                if self.values[j][1] >= e:
                    break
                self.edges.append((i, j, "overlap"))
        self.words: list = []
        self.names: dict[int, int] = {}
        self.linked: dict[int, tuple[int, bool]] = {}
        if NAME_CODES.search(bytes(map(model.codes.__getitem__, WORD.findall(text)))):
            self._name_nodes(model, last)

    def _name_nodes(self, model: Model, last: dict) -> None:
        text = self.text
        words = self.words = list(WORD.finditer(text))
        likely = [i for i, m in enumerate(words) if model.codes[m.group()] & LIKELY]
        looks = {i: model.word(words[i].group()) for i in likely}
        parts = _name_parts(text, words, looks, likely)
        if not parts:
            return
        # every other place where such a word stands is a node too
        held = {words[i].group().casefold() for i in parts}
        for i in likely:
            w = words[i].group()
            if i in parts or w.casefold() in held:
                p = np.array(looks[i])
                self.names[i] = len(self.potential)
                self.potential.append(p - np.array([0.0, 0.3, 0.3]) if w.islower() else p)
        for i, node in self.names.items():
            j = _next(text, words, i)
            if j and j[0] in self.names:
                self.edges.append((node, self.names[j[0]], "comma" if j[1] else "chain"))
                self.linked[i] = j
        for i, node in self.names.items():
            w = words[i].group().casefold()
            if w in last:
                self.edges.append((last[w], node, "same_word"))
            last[w] = node

    def tables(self, model: Model) -> list[tuple[int, int, np.ndarray]]:
        is_id = lambda i: i < len(self.values) and self.values[i][0] == "id_number"
        return [(i, j, model.tables[t] * COPY if t == "same_value" and is_id(i) else model.tables[t]) for i, j, t in self.edges]

    def beliefs(self, model: Model, potential: list[np.ndarray] | None = None) -> list[np.ndarray]:
        potential = self.potential if potential is None else potential
        return propagate(potential, self.tables(model)) if self.edges else potential


def learn(model: Model, texts: list[str], rounds: int = 3, rate: float = 0.5, spread: float = 20.0) -> None:
    """Fit the weights of features and the tables of edges on texts, around their priors.

    The gradient of the partly labelled field: expectations with the sure nodes held at their
    labels, less the free ones. ``spread`` is how many nodes weigh as much as a prior.
    """
    sure_at = 4.0
    fields = []
    for t in texts:
        f = Field(t, model)
        if not f.edges:
            continue
        held = list(f.potential)
        for i, (*_, fs) in enumerate(f.values):
            own = f.potential[i][1]
            if abs(own) >= sure_at:
                held[i] = np.array([0.0, 30.0 if own > 0 else -30.0])
        starts = {m.start(): i for i, m in enumerate(f.words)}
        for m in INTRO.finditer(t):
            at = m.end()
            for w, label in _name_after(t, m.end(), model.given):
                at = t.find(w, at)
                node = f.names.get(starts.get(at, -1))
                if node is not None:
                    held[node] = np.where(np.arange(3) == label, 30.0, 0.0)
                at += len(w)
        fields.append((f, held))
    if not fields:
        return
    prior, prior_tables = model.features.copy(), {k: v.copy() for k, v in model.tables.items()}
    for _ in range(rounds):
        grad, seen = np.zeros_like(model.features), np.zeros_like(model.features)
        pairs = {k: np.zeros_like(v) for k, v in model.tables.items()}
        count = dict.fromkeys(pairs, 0)
        for f, held in fields:
            for i, (*_, fs) in enumerate(f.values):
                f.potential[i][1] = sum(model.features[_F[x]] for x in fs)
            for sign, potential in ((1.0, [h if h is not p and abs(h).max() >= 30 else p for h, p in zip(held, f.potential)]), (-1.0, f.potential)):
                belief = [np.exp(b - b.max()) / np.exp(b - b.max()).sum() for b in f.beliefs(model, potential)]
                for i, (*_, fs) in enumerate(f.values):
                    for x in fs:
                        grad[_F[x]] += sign * belief[i][1]
                        seen[_F[x]] += 0.5
                for (i, j, kind), (_, _, table) in zip(f.edges, f.tables(model)):
                    both = np.outer(belief[i], belief[j]) * np.exp(table - table.max())
                    pairs[kind] += sign * both / both.sum()
                    count[kind] += 0.5
        model.features = model.features + rate * (grad / (seen + spread) * 10 - (model.features - prior) * spread / (seen + spread))
        for k in pairs:
            if k != "overlap":
                model.tables[k] = model.tables[k] + rate * (pairs[k] / (count[k] + spread) * 10 - (model.tables[k] - prior_tables[k]) * spread / (count[k] + spread))


def finds(text: str | None, model: Model, towns: Collection[str] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in a text, sorted by start; towns other than the model's may be given."""
    if not text:
        return []
    f = Field(text, model, towns)
    belief = f.beliefs(model)
    out = _apart([(k, s, e) for i, (k, s, e, _) in enumerate(f.values) if belief[i][1] > belief[i][0]])
    names, linked, words = f.names, f.linked, f.words
    if names:
        label = {i: int(belief[n].argmax()) for i, n in names.items()}
        people = []
        done: set[int] = set()
        for i in names:
            if i in done or label[i] == NONE:
                continue
            j = linked.get(i)
            title = _titled(text, words, i)
            if label[i] == GIVEN and j and not j[1]:
                k = j[0]
                more = linked.get(k)
                if label.get(k) == GIVEN and more and not more[1] and label.get(more[0]) == FAMILY:
                    done |= {i, k, more[0]}
                    people.append((i, more[0]))
                elif label.get(k) == FAMILY:
                    done |= {i, k}
                    people.append((i, k))
            elif label[i] == FAMILY and j and label.get(j[0]) == GIVEN and (j[1] or not _follows(linked, label, j[0])):
                done |= {i, j[0]}
                people.append((i, j[0]))
            elif label[i] == FAMILY and title:
                done.add(i)
                people.append((i, i))
        taken = [(s, e) for _, s, e in out]
        for a, b in people:
            s, e = words[a].start(), words[b].end()
            if not any(s < y and x < e for x, y in taken):
                out.append(("person", s, e))
    return sorted(out, key=lambda x: (x[1], x[2]))


def _name_parts(text: str, words: list, looks: list, likely: list[int]) -> set[int]:
    """Words that stand so that they may make a name: a given and a family name side by side, given names before them, or a family name after a title."""
    out: set[int] = set()
    ready = set(likely)
    for i in likely:
        g, f = looks[i][GIVEN] > GIVEN_LEAST, looks[i][FAMILY] > FAMILY_LEAST
        if i + 1 in ready or i + 1 < len(words) and len(words[i + 1].group()) == 1:
            j = _next(text, words, i)
            if j and j[0] in ready and (g and looks[j[0]][FAMILY] > FAMILY_LEAST or f and looks[j[0]][GIVEN] > GIVEN_LEAST):
                out.update((i, j[0]))
        if f and _titled(text, words, i):
            out.add(i)
    # a further given name directly before a given name taken, from the last on
    for i in reversed(likely):
        if i not in out and looks[i][GIVEN] > GIVEN_LEAST:
            j = _next(text, words, i)
            if j and not j[1] and j[0] in out and looks[j[0]][GIVEN] > GIVEN_LEAST:
                out.add(i)
    return out


def _follows(linked, label, i: int) -> bool:
    j = linked.get(i)
    return bool(j and not j[1] and label.get(j[0]) == FAMILY)


def _next(text: str, words: list, i: int) -> tuple[int, bool] | None:
    """The word a name may go on with after word i: (its number, whether a comma stands between)."""
    if i + 1 >= len(words):
        return None
    gap = text[words[i].end() : words[i + 1].start()]
    if len(words[i + 1].group()) == 1 and words[i + 1].group().isalpha() and GAP_NAME.match(gap) and i + 2 < len(words):
        j, seen = i + 1, 0
        while j < len(words) - 1 and len(words[j].group()) == 1 and seen < 3:
            if not GAP_INITIAL.match(text[words[j].end() : words[j + 1].start()]):
                return None
            j, seen = j + 1, seen + 1
        return (j, False)
    if GAP_NAME.match(gap):
        return (i + 1, False)
    return (i + 1, True) if GAP_COMMA.match(gap) else None


def _titled(text: str, words: list, i: int) -> bool:
    return i > 0 and words[i - 1].group().casefold() in TITLES and bool(GAP_TITLE.match(text[words[i - 1].end() : words[i].start()])) or (
        i > 1 and len(words[i - 1].group()) == 1 and words[i - 2].group().casefold() in TITLES and bool(GAP_INITIAL.match(text[words[i - 1].end() : words[i].start()]))
    )


_ORDER = {k: i for i, k in enumerate(("email", "address", "id_number", "phone"))}


def _apart(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping values: the first kind in order, then the longest, stays."""
    out: list[tuple[str, int, int]] = []
    for k, s, e in sorted(set(found), key=lambda x: (_ORDER[x[0]], x[1] - x[2], x[1])):
        if not any(s < y and x < e for _, x, y in out):
            out.append((k, s, e))
    return out


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with a placeholder like ``[EMAIL]`` for each find; everything else is unchanged."""
    if not text or not found:
        return text
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: x[1]):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


# --- the operator ------------------------------------------------------------------------------


def _map_texts(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """(hash of the text, *row) for every row ``fn`` gives for a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, *x) for h, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()) for x in fn(t)]
        types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        names, kinds = zip(*(c.split() for c in f"{key} bigint, {schema}".split(", ")))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=list(names))

    texts = spread(df.select(F.xxhash64("text").alias("key"), "text").filter(F.length("text") > 0))
    return map_arrow(texts, run, f"{key} bigint, {schema}")


def town_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(town): words after a street, over all texts whole, that are surely a town or stand there twice; a repeated text counts once."""

    def told(text: str) -> list[tuple[str, int, bool]]:
        found = _towns_in(text)
        often, sure = Counter(t for t, _ in found), {t for t, s in found if s}
        return [(t, n, t in sure) for t, n in often.items()]

    rows = _map_texts(df.select(F.col(text_col).alias("text")), "key", told, "town string, n bigint, sure boolean").distinct()
    return rows.groupBy("town").agg(F.sum("n").alias("n"), F.max("sure").alias("sure")).filter("sure or n > 1").select("town")


def train(df: DataFrame, given_names: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, towns: int = TOWNS) -> Model:
    """A model from at most ``sample`` texts of less than ``LONGEST`` characters that hold an introduction or a title, those with the least hash of their id.

    Its towns are those of all texts: held in the model up to ``towns`` of them, else as a table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(rf"(?i)(?<!\w)(?:{INTRODUCTIONS})\s") | F.col("text").rlike(TITLE.pattern)).filter(F.length("text") < LONGEST)
    rows = rows.orderBy(F.xxhash64("id"), "text").limit(sample).select("text")
    names = [r[0] for r in given_names.select("given_name").filter("given_name is not null").distinct().orderBy(F.xxhash64("given_name")).limit(100_000).collect()]
    table = materialize(town_table(df, text_col), "pii-towns")
    few = table.count() <= towns
    model = fit([r[0] for r in rows.collect()], names, towns=frozenset(r[0] for r in table.collect()) if few else frozenset())
    model.town_table = None if few else table
    return model


def _with_towns(rows: DataFrame, model: Model) -> DataFrame:
    """Beside each text the known towns its addresses may end with, where the model does not hold all."""
    if model.town_table is None:
        return rows
    may = _map_texts(rows, "key", lambda t: [(x,) for x in _town_candidates(t)], "town string").distinct()
    known = may.join(model.town_table, "town").groupBy("key").agg(F.collect_list("town").alias("towns"))
    out = rows.withColumn("key", F.xxhash64("text")).join(known, "key", "left")
    return out.select(*rows.columns, F.coalesce("towns", F.array().cast("array<string>")).alias("towns"))


def _batch_finds(batch: pa.RecordBatch, model: Model) -> list[list[tuple[str, int, int]]]:
    texts = batch.column("text").to_pylist()
    towns = batch.column("towns").to_pylist() if "towns" in batch.schema.names else [None] * len(texts)
    return [finds(t, model, w) for t, w in zip(texts, towns)]


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, span_start, span_end): every find in every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") > 0))
    id_type = dict(rows.dtypes)["id"]

    def run(batches):
        m = shared.value
        for batch in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, f in enumerate(_batch_finds(batch, m)):
                for k, s, e in f:
                    at.append(i)
                    kinds.append(k)
                    starts.append(s)
                    ends.append(e)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "kind", "span_start", "span_end"])

    return spread(_with_towns(rows, model)).mapInArrow(run, f"id {id_type}, kind string, span_start int, span_end int").distinct().withColumnRenamed("id", id_col)


def masked(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_finds): every text with its finds replaced by typed placeholders."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    # a repeated id counts once, whichever text is the greatest: before any text is looked through
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("text").alias("text"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, n = [], []
            for t, f in zip(batch.column("text").to_pylist(), _batch_finds(batch, m)):
                texts.append(mask(t, f))
                n.append(len(f))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["id", "text", "n_finds"])

    out = _with_towns(rows, model).mapInArrow(run, f"id {id_type}, text string, n_finds int")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
