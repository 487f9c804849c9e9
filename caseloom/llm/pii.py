"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Seven patterns propose spans.  Four of them, with their checks, give the base
spans, which always stay; a match of theirs that fails its check (a card number
without a valid check digit) is never added.  Every proposed span gets the
votes (1, -1, or 0 for no opinion) of six labelers: a pattern labeler, a shape
labeler, a gazetteer (given names, area codes, domains, card issuers, country
codes, known networks), two context labelers over the words before it, and a
junk-shape labeler.  Expectation-maximisation over the counts of vote patterns
estimates, for each kind of span, how reliable each labeler is; the posteriors
then train a logistic span classifier on features of the span that are none of
the votes.  Proposed addresses in words, national numbers and names that it
accepts, and that overlap no base span, are added.

One pass reads the texts; the proposals with votes and features go to a table
in the shared folder.  What reaches the driver are two aggregates over all of
them, whose sizes are bounded by the code: at most 7 * 3^6 vote patterns and
7 * 4 * 3^4 feature patterns, whatever the input.  Positions and overlaps come
from scans in steps of STEP matches, so a text of very many matches takes
nearly linear time.

Positions come from the pieces between matches, so a text is walked once for
each pattern.  The patterns are possessive and start only where no match could
begin earlier (or right after the last match), so long runs take linear time
and no stack.

Cases: null and empty texts have no spans; repeated rows each get theirs; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.scratch import save

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mention", "number", "name")

#: What is matched.  `\G` allows a match right after the one before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mention": r"\b[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "number": r"(?<![0-9A-Za-z])\(?[0-9]{2,5}+\)?(?:[\x20./-][0-9]{2,7}+){1,5}+(?![0-9A-Za-z])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Do\x{f1}a)\.?\x20\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+){0,2}+",
}
#: A cheap test that a text must pass to hold a match.
HINTS = {"email": "contains(text, '@')", "ip": "has_digit", "card": "has_digit", "phone": "contains(text, '+')", "mention": "(contains(text, 'at]') or contains(text, 'at)') or contains(text, 'at}'))", "number": "has_digit", "name": "true"}

#: Gazetteers and context words.
DOMAINS = "com org net edu gov info io de fr es it uk eu ch at be nl mx ar example".split()
GOOD_WORDS = "tel telephone phone call fax mobile cell mail email contact card visa mastercard amex ip address host server ssn iban account kontakt telefon handy karte konto appelez carte compte tarjeta cuenta llame correo".split()
BAD_WORDS = "version isbn issn page pages fig figure table order invoice ref id no nr art date year since chapter section seite datum jahr page année página fecha".split()

GIVEN = "adam alice andrea andreas anna anne antoine antonio ben camille carlos carmen charles charlotte christian claire claude daniel david elena elisabeth emily emma eric fernando francisco frank george hanna hans heinrich helen henry inge jack james jan javier jean jennifer johann john jorge jose juan julia julie karl kate katrin klaus laura laurent lisa louis lucia luis manuel marc maria marie mark markus martin mary matthias michael michel miguel nicolas olivia oliver pablo patricia paul pedro peter philippe pierre rafael robert rosa sabine sarah sofia sophie stefan susan teresa thomas tom ursula uwe werner william wolfgang".split()
AREA_CODES = "020 030 040 069 089 01 02 03 04 05 06 07 0800 0900 201 202 206 212 213 214 305 310 312 404 408 415 510 512 555 617 646 650 702 713 718 773 800 818 888 900 917 91 93".split()
NETS = r"^(?:10|127|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01])|169\\.254|8\\.8|1\\.1)\\."

#: Matches of one step of a scan.
STEP = 64


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(values: str, start: str, step: str) -> str:
    """SQL: for each place of a non-empty array of numbers, what `step` (of a and x) makes of start and all values before.

    An aggregate that appends copies its array each time, so values are taken
    STEP at a time, after a scan over the steps' totals.
    """
    steps = f"sequence(0, (size({values}) - 1) div {STEP})"
    some = f"slice({values}, u * {STEP} + 1, {STEP})"
    more = f"concat(s, array({_let('a', 'element_at(s, -1)', step)}))"
    heads = f"aggregate(transform({steps}, u -> aggregate({some}, {start}, (a, x) -> {step})), array({start}), (s, x) -> {more})"
    return _let("heads", heads, f"flatten(transform({steps}, u -> slice(aggregate({some}, array(heads[u]), (s, x) -> {more}), 1, size({some}))))")


def _places(m: str, p: str) -> str:
    """SQL: structs of the matches in array m, between the pieces in array p."""
    none = "cast(array() as array<struct<start:bigint,end:bigint,word:string,pre:string,post:string>>)"
    sizes = f"transform(sequence(0, size({m}) - 1), i -> cast(length({p}[i]) + length({m}[i]) as bigint))"
    one = f"named_struct('start', at[i] + length({p}[i]), 'end', at[i] + length({p}[i]) + length({m}[i]), 'word', {m}[i], 'pre', right({p}[i], 24), 'post', left({p}[i + 1], 12))"
    found = _let("sizes", sizes, _let("at", _scan("sizes", "0L", "a + x"), f"transform(sequence(0, size({m}) - 1), i -> {one})"))
    return f"case when size({m}) = 0 then {none} else {found} end"


def _luhn(digits: str) -> str:
    x = f"cast(substr({digits}, length({digits}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + case when i % 2 = 0 then 2 * {x} - case when {x} > 4 then 9 else 0 end else {x} end) % 10 = 0"


def _sound(kind: str, w: str) -> str:
    """SQL: whether a match of a base kind passes its check."""
    digits = f"regexp_replace({w}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": rf"{w} rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.]|$)|0++(?:[.]|$)){{4}}$'",
        "card": f"length({digits}) between 12 and 19 and case when length({digits}) between 12 and 19 then {_luhn(digits)} else false end",
        "phone": f"length({digits}) between 9 and 15",
    }.get(kind, "false")


def _any_word(text: str, words: list[str]) -> str:
    return f"lower({text}) rlike '(?<![\\\\p{{L}}])(?:{'|'.join(words)})(?![\\\\p{{L}}])'"


def _proposal(kind: str) -> str:
    """SQL over x, a match: its span, whether it is a base span, votes and features."""
    w, n = "x.word", f"{KINDS.index(kind)}"
    digits = f"length(regexp_replace({w}, '[^0-9]', ''))"
    sound = _sound(kind, w)
    vote = lambda yes, no: f"cast(case when {yes} then 1 when {no} then -1 else 0 end as tinyint)"
    pattern = vote(sound, f"not ({sound})" if kind in BASE else f"{digits} < 7" if kind == "number" else "false")
    form = {
        "phone": vote(rf"{w} rlike '^[+][0-9]{{1,3}}[ -][(]?[0-9]{{2,4}}[)]?[ -][0-9]'", rf"{w} rlike '[.][.]|[(][(]|[ ]{{2}}'"),
        "number": vote(rf"{w} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$|^[(][0-9]{{3}}[)] [0-9]{{3}}-[0-9]{{4}}$'", rf"{w} rlike '[.].*-|/'"),
        "card": vote(rf"{w} rlike '^[0-9]{{4}}([ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,7}}$'", rf"{w} rlike '[ -].[ -].[ -]'"),
        "email": vote(rf"{w} rlike '^[A-Za-z0-9]'", rf"{w} rlike '^[._%+-]'"),
        "ip": vote(rf"{w} rlike '^[1-9]'", rf"{w} rlike '^0|[.]0[0-9]'"),
        "mention": vote(rf"{w} rlike '^[A-Za-z0-9]' and {w} rlike '(?:[.]|dot[\\])}}])[ ]?[A-Za-z]{{2,}}$'", rf"{w} rlike '[0-9]$'"),
        "name": vote(rf"{w} rlike '^[^ ]+ [^ ]+ [^ ]'", "false"),
    }.get(kind, vote("false", "false"))
    tail = f"lower(regexp_extract({w}, '[.\\\\])}} ]([A-Za-z0-9-]+)$', 1))"
    group = f"regexp_extract({w}, '([0-9]+)', 1)"
    known = {
        "email": vote(f"{tail} in ({', '.join(map(repr, DOMAINS))})", f"{tail} rlike '^[0-9]+$'"),
        "mention": vote(f"{tail} in ({', '.join(map(repr, DOMAINS))})", "false"),
        "name": vote(_any_word(w, GIVEN), "false"),
        "number": vote(f"{group} in ({', '.join(map(repr, AREA_CODES))})", f"{group} rlike '^(19|20)[0-9][0-9]$'"),
        "ip": vote(f"{w} rlike '{NETS}'", f"{w} rlike '^0'"),
        "card": vote(f"{w} rlike '^(4|5[1-5]|3[47]|6011|62)'", f"{w} rlike '^(0|1|9)'"),
        "phone": vote(f"{w} rlike '^[+](1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])'", f"{w} rlike '^[+]0'"),
    }.get(kind, vote("false", "false"))
    good = vote(_any_word("x.pre", GOOD_WORDS), "false")
    bad = vote("false", _any_word("x.pre", BAD_WORDS))
    junk = vote("false", rf"{w} rlike '^([0-9])(?:[ .-]?\\1)++$|^(19|20)[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}$|^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.](19|20)[0-9]{{2}}$'")
    length = f"cast(case when length({w}) < 9 then 0 when length({w}) < 16 then 1 when length({w}) < 24 then 2 else 3 end as tinyint)"
    digit = f"cast(case when {digits} * 10 < length({w}) * 3 then 0 when {digits} * 10 < length({w}) * 9 then 1 else 2 end as tinyint)"
    marks = f"length({w}) - length(regexp_replace({w}, '[^A-Za-z0-9]', ''))"
    mark = f"cast(case when {marks} < 2 then 0 when {marks} < 4 then 1 else 2 end as tinyint)"
    before = "cast(case when x.pre = '' then 0 when x.pre rlike '[ \\\\n\\\\t]$' then 1 else 2 end as tinyint)"
    after = "cast(case when x.post = '' then 0 when x.post rlike '^[ \\\\n\\\\t.,;]' then 1 else 2 end as tinyint)"
    return (
        f"named_struct('start', x.start, 'place', {n}, 'end', x.end, 'kind', '{kind}', 'base', {sound}, "
        f"'votes', array({pattern}, {form}, {known}, {good}, {bad}, {junk}), 'marks', array(cast({n} as tinyint), {length}, {digit}, {mark}, {before}, {after}))"
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every match with start, place (of its kind), end, kind, base, votes, marks; by start, then kind."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    lit = {k: F.lit(p) for k, p in PATTERNS.items()}
    none = F.expr("cast(array() as array<string>)")
    found = texts.select("id", "text", *[F.when(F.expr(HINTS[k]), F.regexp_extract_all("text", lit[k], 0)).otherwise(none).alias(f"m_{k}") for k in KINDS])
    cut = found.select("id", *[f"m_{k}" for k in KINDS], *[F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).alias(f"p_{k}") for k in KINDS])
    placed = cut.select("id", *[F.expr(_places(f"m_{k}", f"p_{k}")).alias(k) for k in KINDS])
    each = [F.expr(f"transform({k}, x -> {_proposal(k)})") for k in KINDS]
    return placed.select("id", F.array_sort(F.concat(*each)).alias("spans"))


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 60, prior: float = 0.5) -> tuple[float, list[dict[int, float]]]:
    """EM over vote patterns with counts: (log odds of the prior, for each labeler the log odds that a vote adds)."""
    if not counts:
        return 0.0, []
    n = len(counts[0][0])
    # begin with votes that are right four times of five; one's opinion, not its silence, tells
    weigh = [{1: math.log(4.0), -1: -math.log(4.0), 0: 0.0} for _ in range(n)]
    share = math.log(prior / (1 - prior))
    total = sum(c for _, c in counts)
    for _ in range(rounds):
        post = [_sigmoid(share + sum(w[v] for w, v in zip(weigh, votes))) for votes, _ in counts]
        yes = sum(p * c for p, (_, c) in zip(post, counts))
        share = math.log((yes + 1) / (total - yes + 1))
        new = []
        for j in range(n):
            at: dict[int, list[float]] = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for p, (votes, c) in zip(post, counts):
                at[votes[j]][0] += p * c
                at[votes[j]][1] += (1 - p) * c
            w = {v: math.log(a / (yes + 1.5)) - math.log(b / (total - yes + 1.5)) for v, (a, b) in at.items()}
            # a labeler is not worse than chance at what it says
            new.append({1: max(0.0, min(w[1], 6.0)), -1: min(0.0, max(w[-1], -6.0)), 0: max(-1.0, min(w[0], 1.0))})
        weigh = new
    return share, weigh


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


#: Share of proposals that are taken for personal data before any vote is seen; so a span without votes isn't added.
PRIOR = 0.4
#: Beyond any position in a text.
FAR = 1 << 40
#: Number of values of each mark.
SIZES = (len(KINDS), 4, 3, 3, 3, 3)


def fit_spans(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[list[float]]:
    """Logistic weights of each mark's values from (marks, sum of posteriors, count), by gradient steps."""
    weights = [[0.0] * size for size in SIZES]
    total = sum(c for *_, c in rows) or 1.0
    for _ in range(rounds):
        grad = [[0.0] * size for size in SIZES]
        for marks, yes, count in rows:
            miss = (yes - count * _sigmoid(sum(w[m] for w, m in zip(weights, marks)))) / total
            for g, m in zip(grad, marks):
                g[m] += miss
        for w, g in zip(weights, grad):
            for i in range(len(w)):
                w[i] += rate * (g[i] - ridge * w[i])
    return weights


def _looked_up(array: str, tables: list[list[float]], shift: int = 0) -> str:
    """SQL: the sum over j of tables[j][array[j] + shift]."""
    parts = [f"element_at(array({', '.join(f'{x!r}D' for x in t)}), cast({array}[{j}] as int) + {shift + 1})" for j, t in enumerate(tables)]
    return " + ".join(parts) or "0D"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """(id, spans): accepted spans with start, place, end, kind, base, p; by start, then kind.

    p is the classifier's probability, base spans are kept whatever it is.
    """
    found = save(proposals(docs, id_col, text_col), "proposals")
    spans = found.where("size(spans) > 0").select(F.explode("spans").alias("s"))
    votes: dict[int, list[tuple[tuple[int, ...], float]]] = {}
    for r in spans.groupBy("s.place", "s.votes").agg(F.count("*").alias("n")).collect():
        votes.setdefault(r.place, []).append((tuple(r.votes), float(r.n)))
    learnt = {k: reliabilities(sorted(counts), prior=PRIOR) for k, counts in sorted(votes.items())}
    cases = [f"when {k} then {share!r}D + {_looked_up('s.votes', [[w[-1], w[0], w[1]] for w in weigh], 1)}" for k, (share, weigh) in learnt.items()]
    post = f"1 / (1 + exp(-(case s.place {' '.join(cases)} end)))"
    rows = spans.groupBy("s.marks").agg(F.sum(F.expr(post)).alias("yes"), F.count("*").alias("n")).collect() if votes else []
    weights = fit_spans([(tuple(r.marks), r.yes, float(r.n)) for r in sorted(rows, key=lambda r: tuple(r.marks))])
    p = f"1 / (1 + exp(-({_looked_up('s.marks', weights)})))"
    scored = F.expr(f"transform(spans, s -> named_struct('start', s.start, 'place', s.place, 'end', s.end, 'kind', s.kind, 'base', s.base, 'p', {p}))")
    # a span overlaps an earlier base span if the farthest end before is beyond its start, a later one if the nearest start is before its end
    before = _scan("ends", "0L", "greatest(a, x)")
    after = f"reverse({_scan('starts', str(FAR) + 'L', 'least(a, x)')})"
    clear = f"s.place >= {len(BASE)} and s.p > {accept!r}D and past[i] <= s.start and next[i] >= s.end"
    kept = f"filter(spans, (s, i) -> s.base or ({clear}))"
    kept = _let("ends", "transform(spans, s -> case when s.base then s.end else 0L end)", _let("past", before, _let("starts", f"reverse(transform(spans, s -> case when s.base then s.start else {FAR}L end))", _let("next", after, kept))))
    return found.select("id", scored.alias("spans")).select("id", F.expr(f"case when size(spans) = 0 then spans else {kept} end").alias("spans"))
