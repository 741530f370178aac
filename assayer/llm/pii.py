"""Personal data by weak supervision.

Base patterns always count.  Looser patterns propose further spans; labelers
(shape, gazetteer, context, structure) vote on every span for or against, or
abstain.  Expectation-maximisation finds from the agreement of the votes how
reliable each labeler is, and a logistic classifier is fitted to the
probabilities it gives.  Texts pass through DataFrame functions only; the driver
sees counts of vote patterns, whose number is fixed by the labelers.

A text is searched for matches of a kind only if it passes the tests of that
kind, which every text with a match does.  Patterns look first at what few
characters are, and at what stands before a place only after that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import stage


def _words(words: list[str]) -> str:
    """A pattern for any of the words; those that begin alike share their first letters."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    each = []
    for letter, rest in tails.items():
        longer = [r for r in rest if r]
        more = _words(longer) if longer else ""
        each.append(letter.replace(".", r"\.") + (f"(?:{more})?" if more and len(longer) < len(rest) else more))
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


# The base patterns.  Possessive repeats and the start of a run
# find the same matches without trying every place inside a long run.  Runs of
# fewer than 13 digits are no cards, nor is any part of them.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?:\G|(?<![0-9]))(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Patterns that a text must hold to hold a match.
NEEDS = {
    "email": r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"\.(?<=[0-9]\.)[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": BASE["phone"],
}
# A character that each match has; bytes are compared, which is cheaper than any pattern.
HAS = {"email": "@", "phone": "+"}
# Kinds of which each match holds a number in several parts or of six digits, a test that they share.
NUMBER, WITH_NUMBER = r"[0-9][A-Z0-9\x20)./-]{4,30}[0-9]", ("ip", "card", "phone_like", "id")

# First names, titles, mail providers and cue words.
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah "
    "Karen Emma Olivia Sophia Daniel Matthew Anthony Mark Paul Steven Andrew Anna Laura Maria Hans Peter Klaus Jürgen Wolfgang Ursula Monika "
    "Sabine Petra Stefan Jean Pierre Michel Jacques Marie Nathalie Isabelle Sylvie Camille José Antonio Manuel Francisco Juan Carmen Ana Isabel "
    "Dolores Pilar Carlos Miguel Luis Sofia"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
PROVIDERS = "gmail googlemail yahoo hotmail outlook icloud aol gmx web proton protonmail mail example".split()
CUES = (
    "call phone tel telephone telefon téléphone teléfono mobile cell fax contact mail email e-mail courriel correo reach write name called "
    "nom nombre named ssn passport passeport pasaporte account konto cuenta compte iban dear signed regards"
).split()
AGAINST = "version chapter page figure table section isbn issn price total order vol volume no. article paragraph year".split()
ID_WORDS = "ssn|social security|social security number|passport|passeport|pasaporte|reisepass|iban|account|konto|cuenta|compte|dni|steuerid|steuer-id".split("|")

_DOT = r"(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\.)"
LOOSE = {
    "email_like": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{2,64}}+(?:\x20?[(\[{{]at[)\]}}]\x20?|\x20at\x20)[A-Za-z0-9-]{{2,63}}+{_DOT}[A-Za-z]{{2,24}}+(?![A-Za-z])",
    "phone_like": r"(?=[(0-9])(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])",
    # What stands before an id ends in a letter or a mark and spaces; all the words are tried only where it does.
    "id": rf"(?=[A-Z0-9])(?=[A-Z]{{0,2}}[0-9])(?<=[A-Za-z.:#]\x20{{0,4}})(?<=(?i:{_words(ID_WORDS)})[.:#]?\x20{{0,2}}(?i:no|nr|number|is)?[.:#]?\x20{{0,2}})[A-Z]{{0,2}}[0-9][A-Z0-9\x20-]{{4,30}}[0-9](?![A-Za-z0-9])",
    "name": rf"(?=[A-Z])(?<!\p{{L}})(?:{_words(TITLES)}\.?\x20\p{{Lu}}\p{{Ll}}{{1,20}}|{_words(FIRST_NAMES)}\x20\p{{Lu}}\p{{Ll}}{{1,20}})(?:\x20\p{{Lu}}\p{{Ll}}{{1,20}})?(?!\p{{L}})",
}
LOOSE_NEEDS = {
    "email_like": rf"[\x20(\[{{]at[\x20)\]}}]\x20?[A-Za-z0-9-]{{2,63}}+{_DOT}[A-Za-z]{{2}}",
    "phone_like": r"[0-9]{2}\)?[\x20./-][0-9]{2,4}[\x20.-][0-9]{2}",
    "id": LOOSE["id"],
    # After a capital that no letter precedes, back to it for the whole word.
    "name": rf"[A-Z](?<!\p{{L}}.)(?<=(?={_words(TITLES + FIRST_NAMES)}\.?\x20\p{{Lu}}\p{{Ll}}).)",
}
KINDS = (*BASE, *LOOSE)
LABELERS = ("shape", "gazetteer", "context", "against", "structure")
#: Characters around a span that the context labelers read.
AROUND = 40
#: Matches that are walked together.
RUN = 64
NO_MATCHES = "cast(array() as array<struct<value:string,start:int,end:int,before:string>>)"
SPAN = "array<struct<kind:string,start:int,end:int,votes:array<int>>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    back = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.struct(F.substr(back, i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The test a base match must pass; matches that fail are dropped."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column, number: Column) -> Column:
    """Whether a text passes the tests of a kind; ``number`` is whether it holds ``NUMBER``."""
    need = text.rlike((NEEDS | LOOSE_NEEDS)[kind])
    need = text.contains(HAS[kind]) & need if kind in HAS else need
    return number & need if kind in WITH_NUMBER else need


def _walked(parts: Column, at: Column, before: Column) -> Column:
    """Matches as (value, start, end, before) of parts (piece, gap, m) that begin at a place, after a text."""
    last = lambda x: F.substring(x, -AROUND, AROUND)

    def step(a: Column, x: Column) -> Column:
        start, before = a["at"] + x["gap"], last(F.concat(a["before"], x["piece"]))
        end = start + F.length(x["m"])
        match = F.struct(x["m"].alias("value"), start.alias("start"), end.alias("end"), before.alias("before"))
        return F.struct(end.alias("at"), last(F.concat(before, x["m"])).alias("before"), F.concat(a["out"], F.array(match)).alias("out"))

    return F.aggregate(parts, F.struct(at.alias("at"), before.alias("before"), F.expr(NO_MATCHES).alias("out")), step, lambda a: a["out"])


def _matches(text: Column, pattern: str, need: Column) -> Column:
    """Matches of a pattern as (value, start, end, before), in code points.

    The pieces between the matches give the places: a match begins where the
    pieces and matches before it end.  ``before`` is the text before a match,
    of ``AROUND`` characters at most.  A walk copies all it has found at each
    step, so long lists are walked in runs, which begin where those before end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern), found, lambda p, m: F.struct(p.alias("piece"), F.length(p).alias("gap"), m.alias("m")))
    parts = F.filter(parts, lambda x: x["m"].isNotNull())
    zero, empty = F.lit(0).cast("int"), F.lit("")

    def cut(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(RUN)), lambda i: F.slice(parts, i, F.lit(RUN)))

    def whole(run: Column) -> Column:
        length = F.aggregate(run, zero, lambda a, x: a + x["gap"] + F.length(x["m"]))
        end = F.aggregate(run, empty, lambda a, x: F.substring(F.concat(a, x["piece"], x["m"]), -AROUND, AROUND))
        return F.struct(end.alias("piece"), length.alias("gap"), empty.alias("m"))

    def joined(runs: Column) -> Column:
        ends = F.transform(_walked(F.transform(runs, whole), zero, empty), lambda r: F.struct(r["start"].alias("at"), r["before"].alias("before")))
        starts = F.slice(F.concat(F.array(F.struct(zero.alias("at"), empty.alias("before"))), ends), F.lit(1), F.size(runs))
        return F.flatten(F.zip_with(runs, starts, lambda run, s: _walked(run, s["at"], s["before"])))

    # An array of one gives a name to what is used several times.
    walked = F.get(F.transform(F.transform(F.array(parts), cut), joined), F.lit(0))
    return F.when(need, walked).otherwise(F.expr(NO_MATCHES))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def _votes(kind: str, m: Column) -> Column:
    """Votes of the labelers on a match, in the order of ``LABELERS``."""
    before, value, digits = F.lower(m["before"]), m["value"], F.length(_digits(m["value"]))
    cue = before.rlike(rf"(?<!\p{{L}})(?:{_words(CUES)})(?!\p{{L}})[^\n]{{0,16}}$")
    doubt = before.rlike(rf"(?<!\p{{L}})(?:{_words(AGAINST)})[^\p{{L}}\n]{{0,6}}$|[$€£%]\x20?$")
    if "email" in kind:
        shape = F.lit(1) if kind == "email" else _vote(value.rlike(r"[(\[{]at[)\]}]|\x20at\x20.*\x20dot\x20"), value.rlike(r"\x20at\x20[^.]*\."))
        gazetteer = _vote(F.lower(value).rlike(rf"(?:{_words(PROVIDERS)})\d*(?:\.|\x20?[(\[{{]?dot)"))
        structure = _vote(value.rlike(r"(?:com|net|org|edu|gov|de|fr|es|uk|io|eu)$"))
    elif kind == "name":
        shape = _vote(value.rlike(rf"^(?:{_words(TITLES)})\.?\x20"))
        gazetteer = _vote(value.rlike(rf"(?<!\p{{L}})(?:{_words(FIRST_NAMES)})(?!\p{{L}})"))
        structure = _vote(F.size(F.split(value, r"\x20")) >= 3)
    elif kind == "id":
        shape = _vote(value.rlike(r"^[A-Z]{2}[0-9]{2}|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
        gazetteer = F.lit(1)
        structure = _vote(digits.between(7, 30), digits < 6)
    elif kind == "ip":
        shape, gazetteer, structure = F.lit(1), F.lit(0), _vote(~value.rlike(r"^(?:0|127|255)\."))
    elif kind == "card":
        shape, gazetteer, structure = F.lit(1), _vote(_digits(value).rlike("^(?:4|5[1-5]|3[47]|6)")), F.lit(1)
    else:
        shape = F.lit(1) if kind == "phone" else _vote(value.rlike(r"^\([0-9]+\)|^0"))
        gazetteer = _vote(value.rlike(r"^\+(?:1|33|34|44|49)(?![0-9])"))
        structure = _vote(digits.between(9, 12), (digits < 8) | _digits(value).rlike(r"^(\d)\1+$|^(?:19|20)\d\d"))
    return F.array(shape, gazetteer, _vote(cue), F.when(doubt, -1).otherwise(0), structure).cast("array<int>")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, the base spans and the looser ones, with their votes."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body, number = F.col("text"), F.col("number")
    rows = rows.withColumn("number", body.rlike(NUMBER))
    rows = rows.select("doc_id", *[_matches(body, pattern, _may_hold(kind, body, number)).alias(kind) for kind, pattern in (BASE | LOOSE).items()])

    def spans(kind: str) -> Column:
        kept = F.filter(F.col(kind), lambda m: _valid(kind, m["value"])) if kind in BASE else F.col(kind)
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _votes(kind, m).alias("votes")))

    rows = rows.select("doc_id", F.concat(*map(spans, BASE)).cast(SPAN).alias("base"), F.concat(*map(spans, LOOSE)).cast(SPAN).alias("loose"))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", apart.alias("loose"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is personal data, and the tables behind it.

    ``tables[c, j, v + 1]`` is how often labeler j votes v (-1, 0, 1) on spans of
    class c.  Each labeler starts out better than chance, and pseudo counts keep
    it so where few spans speak.  No spans: no probabilities.
    """
    n = votes.shape[1]
    prior = np.array([[[0.3, 0.5, 0.2]] * n, [[0.1, 0.4, 0.5]] * n])
    tables, share = prior.copy(), 0.3
    if not len(votes):
        return np.zeros(0), tables
    at = votes + 1
    for _ in range(rounds):
        logs = np.stack([np.log(tables[c][np.arange(n), at]).sum(1) for c in (0, 1)])
        odds = logs[1] - logs[0] + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        share = float(((p * counts).sum() + 3) / (counts.sum() + 10))
        for c, weight in ((0, (1 - p) * counts), (1, p * counts)):
            held = np.stack([(weight[:, None] * (at == v)).sum(0) for v in range(3)], 1) + 20 * prior[c]
            tables[c] = held / held.sum(1, keepdims=True)
    return p, tables


def _inputs(kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """1, each labeler's for and against, and the kind."""
    return np.hstack([np.ones((len(kind), 1)), votes == 1, votes == -1, kind[:, None] == np.arange(len(KINDS))[None]]).astype(float)


def train(kind: np.ndarray, votes: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the span classifier, fitted to the probabilities by ridge-held gradient steps."""
    p, _ = reliabilities(votes, counts)
    x = _inputs(kind, votes)
    w = np.zeros(x.shape[1] if len(kind) else 1 + 2 * len(LABELERS) + len(KINDS))
    if not len(kind):
        w[0] = -1.0
        return w
    weight = counts / counts.sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (q - p)) + 1e-4 * w
        bend = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(span: Column, w: np.ndarray) -> Column:
    n = len(LABELERS)
    total = F.lit(float(w[0]))
    for j in range(n):
        vote = F.get(span["votes"], F.lit(j))
        total = total + F.when(vote == 1, float(w[1 + j])).when(vote == -1, float(w[1 + n + j])).otherwise(0.0)
    kinds = F.lit(0.0)
    for k, name in enumerate(KINDS):
        kinds = F.when(span["kind"] == name, float(w[1 + 2 * n + k])).otherwise(kinds)
    return total + kinds


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, base and added (kind, start, end, votes), by kind and place.

    Added spans overlap no base span, and the classifier gives them one half or
    more.  Null and empty texts have no spans; repeated rows and null keys stay;
    no rows give no rows; further columns are not carried.  Every text is read
    once: spans are written to the shared folder, the votes counted there.
    """
    found = stage(candidates(docs, key, text), "spans")
    each = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    patterns = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes")).count().orderBy("kind", "votes").collect()
    w = train(
        np.array([KINDS.index(r["kind"]) for r in patterns], int),
        np.array([r["votes"] for r in patterns], int).reshape(-1, len(LABELERS)),
        np.array([r["count"] for r in patterns], float),
    )
    return found.select("doc_id", "base", F.filter("loose", lambda s: _logit(s, w) >= 0).alias("added"))
