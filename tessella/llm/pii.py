"""Personal data: fixed patterns, and boosted trees over what high-recall generators propose.

All work on documents is Spark SQL expressions: a pattern's matches and the text between them
give the places, generators propose further spans that may overlap, features of format and
context feed gradient-boosted trees written out as CASE expressions, and a threshold selects,
calibrated for each kind apart. Nothing is shuffled and no Python runs on the executors.

The trees are fitted by the driver on SAMPLE labelled snippets that this module makes itself, in
the company of English, German, French and Spanish words; their features come from the same expressions. Spans are code points, end exclusive. A
proposed span that overlaps a base span, or a better proposal, is dropped.

Null text counts as empty text: no spans. Every row gives one row, repeated rows too, and an empty table
none; other columns are not read. The time taken is linear in a text's length and in its spans.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

KINDS = ("email", "ip", "card", "phone", "number", "bank")
#: Labelled snippets for the trees; a quarter calibrates.
SAMPLE = 4000
#: Base patterns in forms that never go back over a run of characters, so that long runs take linear time.
#: A match may begin only where a run begins, or where the match before has ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators: kind, a text that must be there (or none), pattern.
GENERATORS = (
    ("email", "", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]{2,40}+(?:(?:\.|\x20?[\[({]?(?:dot|DOT)[\])}]?\x20?)[A-Za-z0-9-]{2,20}+){1,3}+"),
    ("phone", "", r"(?<![0-9A-Za-z+.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("phone", "", r"(?<![0-9A-Za-z+.-])(?<![0-9]\x20)0[0-9]{1,5}[\x20/-]{1,2}[0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,4}+(?![0-9])"),
    ("card", "", r"(?<![0-9A-Za-z.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])"),
    ("number", "-", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("bank", "", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("ip", ":", r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
)
#: Beginnings of words that tell what a span is, in English, German, French and Spanish.
_CONTEXT = {
    "phone": "phone|tel|tél|call|mobile|fax|cell|whatsapp|dial|text me|anruf|handy|mobil|rufen|appel|portable|llam|móvil|movil",
    "mail": "mail|e-mail|contact|write|reach|schreib|kontakt|écri|ecri|courriel|escrib|correo",
    "card": "card|visa|master|amex|payment|credit|debit|karte|kreditkarte|zahlung|carte|paiement|crédit|tarjeta|pago",
    "id": "ssn|social|security|passport|tax|identity|sozialversicherung|ausweis|steuer|reisepass|sécurité|securite|passeport|identité|fiscal|seguridad|pasaporte|identidad|dni",
    "bank": "iban|bank|account|transfer|swift|konto|überweis|ueberweis|compte|virement|banque|cuenta|banco",
    "net": "ip|host|server|address|login|from|rechner|adresse|anmeldung|serveur|hôte|connexion|servidor|dirección|direccion|equipo",
    "other": "order|invoice|part|sku|version|isbn|serial|model|page|item|ref|réf|batch|build|bestell|rechnung|teil|seite|artikel|commande|facture|pièce|piece|article|modèle|pedido|factura|pieza|página|pagina|artículo|articulo|lote",
}
#: Characters before a span that its features see.
CONTEXT = 32
FEATURES = ("digits", "letters", "marks", "distinct", "size", "luhn", *(f"near_{k}" for k in _CONTEXT), "before_word", "after_word", "brackets", "source")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.when((n >= 1) & (n <= 40), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


#: A fold goes over blocks of so many items, since each step of an aggregate copies all that it holds.
_BLOCK = 64
_SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"
Step = Callable[[Column, Column], tuple[dict[str, Column], Column]]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(items: Column, kind: str, state: dict[str, Column], step: Step) -> Column:
    """array<kind> of what step(state, item) gives for each item in turn: the next state, and an array of outputs.

    The first pass finds each block's state at its start, the second each block's outputs, so the
    time is linear, but for one small state a block.
    """
    zero, empty = F.struct(*(v.alias(k) for k, v in state.items())), F.array().cast(f"array<{kind}>")

    def packed(new: dict[str, Column]) -> Column:
        return F.struct(*(new[k].alias(k) for k in state))

    def outputs(block: Column, first: Column) -> Column:
        def merge(acc: Column, x: Column) -> Column:
            new, out = step(acc["state"], x)
            return F.struct(packed(new).alias("state"), F.when(F.size(out) > 0, F.concat(acc["out"], out)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(first.alias("state"), empty.alias("out")), merge, lambda acc: acc["out"])

    def next_block(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["state"], lambda st, x: packed(step(st, x)[0])).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

    def over(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts")), next_block, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(blocks, starts, outputs))

    def cut(its: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(its) - 1) / _BLOCK).cast("int")), lambda b: F.slice(its, b * _BLOCK + 1, _BLOCK))

    return _let(items, lambda its: F.when(F.size(its) <= _BLOCK, outputs(its, zero)).otherwise(_let(cut(its), over)))


def _matches(text: Column, need: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(need)), found).otherwise(F.lit(None)) if need else found


def _located(text: Column, matches: Column, pattern: str, context: bool = False) -> Column:
    """Places of matches: the text between them is what splitting leaves. With context also the CONTEXT
    characters before each, and the one after it."""
    pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("s")))
    none, empty = F.lit(None).cast(_SPAN), F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        # The match before is given out now that what follows it is known.
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(CONTEXT)) if context else F.lit("")
        tail = F.right(F.concat(before, x["s"]), F.lit(CONTEXT)) if context else F.lit("")
        held, after = acc["held"], F.concat(x["gap"], F.coalesce(F.left(x["s"], F.lit(1)), F.lit("")))
        shown = F.struct(held["start"].alias("start"), held["end"].alias("end"), held["s"].alias("s"), held["before"].alias("before"), (F.left(after, F.lit(1)) if context else F.lit("")).alias("after"))
        new = F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"), before.alias("before"), F.lit("").alias("after"))
        return {"at": F.coalesce(end, start), "tail": F.coalesce(tail, F.lit("")), "held": F.when(x["s"].isNotNull(), new).otherwise(none)}, F.when(held.isNotNull(), F.array(shown)).otherwise(empty)

    folded = _fold(pairs, _SPAN, {"at": F.lit(0), "tail": F.lit(""), "held": none}, step)
    return F.when(F.size(matches) > 0, folded).otherwise(F.lit(None).cast(f"array<{_SPAN}>"))


def _valid(kind: str) -> object:
    def digits(s: Column) -> Column:
        return F.regexp_replace(s["s"], "[^0-9]", "")

    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return lambda s: s["s"].rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return lambda s: F.length(digits(s)).between(13, 19) & luhn(digits(s))
    if kind == "phone":
        return lambda s: F.length(digits(s)).between(9, 15)
    return None


def features(span: Column, source: int) -> Column:
    """Of one proposed span: its format, and what stands around it."""
    s, before = span["s"], span["before"]
    low = F.lower(before)
    digits = F.regexp_replace(s, "[^0-9]", "")
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    values = {
        "digits": F.length(digits),
        "letters": letters,
        "marks": F.length(s) - F.length(digits) - letters,
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "size": F.length(s),
        "luhn": luhn(digits).cast("int"),
        **{f"near_{k}": low.rlike(rf"(?<![a-zà-ÿ0-9_])(?:{words})").cast("int") for k, words in _CONTEXT.items()},
        "before_word": before.rlike("[A-Za-z0-9]$").cast("int"),
        "after_word": span["after"].rlike("[A-Za-z0-9]").cast("int"),
        "brackets": s.rlike(r"[(\[{]").cast("int"),
        "source": F.lit(source),
    }
    return F.struct(*(values[f].cast("double").alias(f) for f in FEATURES))


def _proposals(df: DataFrame) -> DataFrame:
    """df(text, ...) with column proposed: array of (kind, start, end, x), x the features."""
    raw = df.select("*", *(_matches(F.col("text"), need, p).alias(f"_g{k}") for k, (_, need, p) in enumerate(GENERATORS)))
    placed = raw.select(*df.columns, *(_located(F.col("text"), F.col(f"_g{k}"), p, True).alias(f"_g{k}") for k, (_, _, p) in enumerate(GENERATORS)))

    def each(k: int, kind: str) -> Column:
        out = F.transform(f"_g{k}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(s, k).alias("x")))
        return F.coalesce(out, F.array().cast(_PROPOSED))

    return placed.select(*df.columns, F.when(F.coalesce(*(f"_g{k}" for k in range(len(GENERATORS)))).isNotNull(), F.concat(*(each(k, g[0]) for k, g in enumerate(GENERATORS)))).alias("proposed"))


_PROPOSED = f"array<struct<kind:string,start:int,end:int,x:struct<{','.join(f'{f}:double' for f in FEATURES)}>>>"


@dataclass(frozen=True)
class Trees:
    """Sum of depth-two trees (feature, cut, (feature, cut, low, high) twice), and for each kind the calibration of the sum:
    slope, offset, and the threshold that its probability must reach."""

    trees: tuple
    kinds: dict[str, tuple[float, float, float]]

    def margin(self, x: Column) -> Column:
        def node(t: tuple) -> Column:
            f, cut, a, b = t
            low, high = (node(v) if isinstance(v, tuple) else F.lit(v) for v in (a, b))
            return F.when(x[FEATURES[f]] <= cut, low).otherwise(high)

        return reduce(lambda a, b: a + b, (node(t) for t in self.trees))

    def _of(self, kind: Column, k: int) -> Column:
        return reduce(lambda acc, item: acc.when(kind == item[0], item[1][k]), self.kinds.items(), F.when(F.lit(False), 0.0))

    def probability(self, x: Column, kind: Column) -> Column:
        return 1 / (1 + F.exp(-(self.margin(x) * self._of(kind, 0) + self._of(kind, 1))))

    def chosen(self, p: Column, kind: Column) -> Column:
        return p >= self._of(kind, 2)

    def margins(self, x: np.ndarray) -> np.ndarray:
        def node(t: tuple, row: np.ndarray) -> float:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return np.array([sum(node(t, r) for t in self.trees) for r in x])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether they reach their kind's threshold."""
        own = np.array([self.kinds[kind] for kind in kinds_of(x)]).reshape(-1, 3)
        p = 1 / (1 + np.exp(-(self.margins(x) * own[:, 0] + own[:, 1])))
        return p, p >= own[:, 2]


def kinds_of(x: np.ndarray) -> list[str]:
    """The kind of each row of features, by the generator that proposed it."""
    return [GENERATORS[int(k)][0] for k in x[:, FEATURES.index("source")]]


def calibrated(m: np.ndarray, t: np.ndarray, precision: float) -> tuple[float, float, float]:
    """(slope, offset, threshold) for margins m of labels t: a logistic curve, drawn to the margin itself where there is
    little to go by, and the least probability, 0.5 at least, from which on precision is reached; 1 and more if none does."""
    w = np.array([1.0, 0.0])
    d = np.stack([m, np.ones(len(m))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d + 0.05 * np.eye(2), d.T @ (t - q) - 0.05 * (w - [1, 0]))
    q = 1 / (1 + np.exp(-d @ w))
    good = [c for c in np.unique(np.floor(q * 1000) / 1000) if c >= 0.5 and (chosen := q >= c).any() and t[chosen].mean() >= precision]
    return float(w[0]), float(w[1]), float(good[0]) if good else 1.01


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, precision: float = 0.98) -> Trees:
    """Newton-boosted depth-two trees on three quarters of the rows; the rest calibrates their sum, each kind apart."""
    held = np.arange(len(y)) % 4 == 3
    a, b = x[~held], y[~held]
    cuts = [(f, c) for f in range(x.shape[1]) for c in (np.unique(a[:, f])[:-1] + np.unique(a[:, f])[1:]) / 2]
    below = np.array([a[:, f] <= c for f, c in cuts])

    def split(g: np.ndarray, h: np.ndarray) -> int:
        gl, hl = below @ g, below @ h
        gr, hr = g.sum() - gl, h.sum() - hl
        return int((gl**2 / (hl + 1) + gr**2 / (hr + 1)).argmax())

    def leaf(g: np.ndarray, h: np.ndarray) -> float:
        return float(rate * g.sum() / (h.sum() + 1))

    score, trees = np.zeros(len(b)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        top = split(g, h)
        sides, value = [], np.zeros(len(b))
        for side in (below[top], ~below[top]):
            k = split(g * side, h * side)
            one, two = side & below[k], side & ~below[k]
            low, high = leaf(g[one], h[one]), leaf(g[two], h[two])
            value[one], value[two] = low, high
            sides.append((cuts[k][0], float(cuts[k][1]), low, high))
        score += value
        trees.append((cuts[top][0], float(cuts[top][1]), *sides))
    raw = Trees(tuple(trees), {})
    kinds, m = np.array(kinds_of(x[held])), raw.margins(x[held])
    return Trees(raw.trees, {kind: calibrated(m[kinds == kind], y[held][kinds == kind], precision) for kind in sorted({g[0] for g in GENERATORS})})


def snippets(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled texts with one proposed span each: personal data in its usual company, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "tion", "on", "the", "li", "mo", "ka", "st", "sch", "ung", "eau", "é", "ción", "os", "ein"]) for _ in range(r.randint(1, 3)))

    def card(good: bool) -> str:
        body = "4" + d(14)
        total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(body))
        last = (-total) % 10
        return body + str(last if good else (last + r.randint(1, 9)) % 10)

    def grouped(s: str, mark: str) -> str:
        return mark.join(s[k : k + 4] for k in range(0, len(s), 4))

    def one(kind: str, own: bool) -> str:
        near = {
            "phone": ["call", "tel", "Tel:", "phone", "mobile", "fax", "Telefon", "Anruf unter", "Handy", "Tél.", "appelez le", "portable", "teléfono", "llame al", "móvil"],
            "mail": ["mail", "contact", "write to", "E-Mail", "schreiben an", "Kontakt", "écrire à", "courriel", "correo", "escriba a"],
            "card": ["card", "credit card", "visa", "payment", "Karte", "Kreditkarte", "Zahlung", "carte", "paiement", "tarjeta", "pago"],
            "id": ["ssn", "SSN:", "social security", "tax id", "Sozialversicherung", "Ausweis", "Steuer", "sécurité sociale", "passeport", "seguridad social", "pasaporte", "DNI"],
            "bank": ["IBAN", "bank account", "transfer to", "Konto", "Überweisung an", "compte", "virement à", "cuenta", "banco"],
            "net": ["host", "server", "ip address", "login from", "Rechner", "Adresse", "serveur", "connexion", "servidor", "dirección"],
        }
        off = ["order", "invoice", "part", "sku", "version", "isbn", "serial", "model", "page", "item", "ref", "batch", "Bestellung", "Rechnung", "Teil", "Seite", "Artikel", "commande", "facture", "pièce", "article", "réf.", "pedido", "factura", "pieza", "página", "lote"]
        if kind == "email":
            mark = r.choice([" (at) ", "[at]", " [at] ", "(at)"])
            dot = r.choice([".", " [dot] ", " dot ", "(dot)"])
            name = r.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}"])
            if own:
                return f"{r.choice(['', r.choice(near['mail'])])} {name}xx{mark}{word()}xx{dot}{r.choice(['com', 'org', 'net'])}"
            return f"{r.choice(['', r.choice(off)])} {name}xx (at) {word()}xx dot {word()}xx dot {word()}xx"
        if kind == "phone":
            s = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(2)}/{d(4)}-{d(2)}"])
            return f"{r.choice(near['phone']) if own else r.choice(['', *off, word()])} {s}"
        if kind == "card":
            mark = r.choice("./_")
            return f"{r.choice(['', *near['card']])} {grouped(card(True), mark)}" if own else f"{r.choice(['', *off])} {grouped(card(False), mark)}"
        if kind == "number":
            s = f"{d(3)}-{d(2)}-{d(4)}"
            return f"{r.choice(near['id'])} {s}" if own else f"{r.choice(['', *off, word()])} {s}"
        if kind == "bank":
            if own:
                return f"{r.choice(near['bank'])} {r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {grouped(d(r.choice([16, 18, 20])), r.choice(['', ' ']))}"
            return f"{r.choice(['', *off, word()])} {r.choice(['AB', 'XK', 'QR'])}{d(2)}{''.join(r.choice('ABCDEFG0123456789') for _ in range(r.choice([12, 16])))}"
        s = ":".join(f"{r.getrandbits(16):x}" for _ in range(8))
        return f"{r.choice(near['net'])} {s}" if own else f"{r.choice(['', *off, word()])} {s}"

    out = []
    for k in range(n):
        own = r.random() < 0.5
        core = one(r.choice(("email", "phone", "card", "number", "bank", "ip")), own)
        out.append((f"{word()} {word()} {core} {word()} {word()}", int(own)))
    return out


_fitted: dict[int, Trees] = {}


def trained(spark: SparkSession, sample: int = SAMPLE) -> Trees:
    """Fitted once in a driver process."""
    if sample not in _fitted:
        rows = spark.createDataFrame(snippets(sample), "text string, y int").coalesce(1)
        got = _proposals(rows).where(F.size("proposed") > 0).select("y", F.element_at("proposed", 1)["x"].alias("x")).collect()
        _fitted[sample] = fit(np.array([tuple(r.x) for r in got]), np.array([float(r.y) for r in got]))
    return _fitted[sample]


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """(doc_id, base, added) for every row of docs(doc_id, text): arrays of (kind, start, end)."""
    model = model or trained(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = df.select("*", *(_matches(F.col("text"), need, p).alias(k) for k, (need, p) in BASE.items()))
    placed = raw.select(*df.columns, *(_located(F.col("text"), F.col(k), p).alias(k) for k, (_, p) in BASE.items()))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def kept(kind: str) -> Column:
        good = _valid(kind)
        spans = F.filter(kind, good) if good else F.col(kind)
        return F.coalesce(F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), empty)

    based = _proposals(placed.select(*df.columns, F.concat(*map(kept, BASE)).alias("base")))
    scored = F.transform("proposed", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), model.probability(p["x"], p["kind"]).alias("p")))
    item = "struct<start:int,rank:int,end:int,kind:string,p:double>"
    good = F.filter(scored, lambda s: model.chosen(s["p"], s["kind"]))
    own = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p")))
    fixed = F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(2.0).alias("p")))
    none, empty_items = F.lit(None).cast(item), F.array().cast(f"array<{item}>")

    def after_base(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        """Drops proposals that a base span reaches into from the left."""
        reach = F.when(x["rank"] == 0, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"])
        return {"reach": reach}, F.when((x["rank"] == 0) | (acc["reach"] <= x["start"]), F.array(x)).otherwise(empty_items)

    def before_base(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        """From the right: drops proposals that reach into the next base span, and the base spans."""
        return {"next": F.when(x["rank"] == 0, x["start"]).otherwise(acc["next"])}, F.when((x["rank"] == 1) & (x["end"] <= acc["next"]), F.array(x)).otherwise(empty_items)

    def best_of(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        """Of proposals that clash, the better; what no later one can clash with is given out. A last item of rank 2 gives out the rest."""
        last = acc["last"]
        clash = F.coalesce(last["end"] > x["start"], F.lit(False)) & (x["rank"] < 2)
        return {"last": F.when(~clash | (x["p"] > last["p"]), x).otherwise(last)}, F.when(last.isNotNull() & ~clash, F.array(last)).otherwise(empty_items)

    end = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2).alias("rank"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("p")))
    left = _fold(F.array_sort(F.concat(own, fixed)), item, {"reach": F.lit(-1)}, after_base)
    apart = F.reverse(_fold(F.reverse(left), item, {"next": F.lit(2**31 - 1)}, before_base))
    best = _fold(F.concat(apart, end), item, {"last": none}, best_of)
    added = F.transform(best, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return based.select("doc_id", "base", F.coalesce(F.when(F.size("proposed") > 0, added), empty).alias("added"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))

    def text(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = F.array(*(F.lit(k) for k in KINDS))
    ranked = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    every = F.when(F.size("added") > 0, F.transform(ranked, lambda s: F.struct(F.get(order, (s["k"] - 1).cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.col("base"))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))
