"""Personal data in texts: strict formats, and boosted trees over high-recall candidates. DataFrame operations only.

Base kinds are found by format and checked (address parts, Luhn digits, digit counts). Beyond them, generators
propose overlapping candidate spans with a kind: digit groups as phone, card or ssn, bracketed addresses as email, account numbers as iban; long runs with a digit, values
assigned to names like token or password, keys with a known prefix and private-key blocks as secret. Features of format, entropy and both contexts
of each candidate go through gradient-boosted trees, written out as SQL; a candidate is selected when its
calibrated probability reaches its kind's threshold. Candidates that overlap a base span are dropped, and so are selected ones inside a longer selected one; what overlaps in part stays.

No table labels personal data, so the trees are fitted on TRAINING_TEXTS generated sentences (a fixed bound) that pass through the same SQL
features; a third of them calibrates the probabilities and sets each kind's threshold at a precision of 0.99 or more.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import calibrate, fit
from .common import let, prepare

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
TRAINING_TEXTS, SEED = 4000, 11
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: kind: (a cheap test of the whole text, what to find). Possessive forms and the start conditions keep matching linear; they find what the plain forms find.
_BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_GENERATORS = {
    "digits": (r"[0-9][ ().\-/]{0,2}[0-9]", r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,30}(?![0-9A-Za-z])", ("phone", "card", "ssn")),
    "groups": (r"[0-9]{3}[ .)-]{1,2}[0-9]{2}", r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])", ("phone", "ssn")),
    "address": (r"[\[({<] ?(?:at|AT|@) ?[\])}>]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({<] ?(?:dot|DOT|\.) ?[\])}>]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+", ("email",)),
    "account": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ("iban",)),
    "run": (r"[0-9](?:(?<=[A-Za-z+/_-][0-9])|(?=[A-Za-z+/_-]))", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}", ("secret",)),
    "assigned": (r"[=:][ \t]{0,3}[\"']?[^\s\"'<>]{6}", r"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|secret|private)[_ -]?key|auth)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^\s\"'<>]{6,}+", ("secret",)),
    "marked": (("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ", "PRIVATE KEY"), r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?)|-----BEGIN (?:[A-Z]++ ){0,4}?PRIVATE KEY-----[^-]*+(?:-----END (?:[A-Z]++ ){0,4}?PRIVATE KEY-----)?", ("secret",)),
}
_BLOCK = 256


def _located(df: DataFrame, name: str, gate: str | tuple[str, ...], pattern: str) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches as (s, e, m, g, r): start, end (code points), match, and up to 40 and 24 characters of the text between it and the matches before and after.

    ``gate`` is a pattern that starts with one class of characters, or strings one of which a match holds; only texts with it are searched. Starts are sums of lengths, taken in blocks, so a text of many matches costs far less than their square.
    """
    p, none = F.lit(pattern), F.expr("cast(array() as array<string>)")
    has = F.col("text").rlike(gate) if isinstance(gate, str) else reduce(or_, [F.col("text").contains(x) for x in gate])
    df = df.withColumn("_f", F.when(has, F.regexp_extract_all("text", p, F.lit(0))).otherwise(none))
    df = df.withColumn("_g", F.when(F.size("_f") > 0, F.split("text", pattern, -1)).otherwise(none))
    lengths = "zip_with(slice(_g, 1, size(_f)), _f, (g, f) -> char_length(g) + char_length(f))"
    sums = f"transform(sequence(0, size(_f) div {_BLOCK}), b -> aggregate(slice(l, cast(b * {_BLOCK} + 1 as int), {_BLOCK}), 0, (a, x) -> a + x))"
    before = "transform(u, (x, b) -> aggregate(slice(u, 1, b), 0, (a, y) -> a + y))"
    start = f"get(b, cast(i div {_BLOCK} as int)) + aggregate(slice(l, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x) + char_length(get(g, i))"
    near = "'g', right(get(g, i), 40), 'r', left(get(g, i + 1), 24)"
    spans = f"transform(transform(f, (m, i) -> named_struct('s', {start}, 'm', m, {near})), x -> named_struct('s', x.s, 'e', x.s + char_length(x.m), 'm', x.m, 'g', x.g, 'r', x.r))"
    found = let("f", "_f", let("g", "_g", let("l", lengths, let("u", sums, let("b", before, spans)))))
    return df.withColumn(name, F.expr(found)).drop("_f", "_g")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """Whether a digit string passes Luhn."""
    value = "cast(substr(reverse(d), i, 1) as int) * (2 - i % 2)"
    return let("d", x, f"aggregate(transform(sequence(1, greatest(1, char_length(d))), i -> {value}), 0, (a, v) -> a + IF(v > 9, v - 9, v)) % 10 = 0 AND d <> ''")


def _mod97(x: str) -> str:
    """Whether an account number without blanks has remainder 1 when its first four characters move to the end and letters count from 10."""
    code = "ascii(substr(w, i, 1))"
    step = f"IF({code} >= 65, (a * 100 + {code} - 55) % 97, (a * 10 + {code} - 48) % 97)"
    return let("t", x, let("w", "concat(substr(t, 5), substr(t, 1, 4))", f"aggregate(sequence(1, greatest(1, char_length(w))), 0, (a, i) -> {step}) = 1"))


def _base(df: DataFrame) -> DataFrame:
    """Add ``base``: checked spans of the base kinds as (s, e, k), k being the kind's place in KINDS."""
    checks = {
        "email": "true",
        "ip": rf"m.m rlike r'^{_PART}(?:\.{_PART}){{3}}\z'",
        "card": f"char_length({_digits('m.m')}) between 12 and 19 AND {_luhn(_digits('m.m'))}",
        "phone": f"char_length({_digits('m.m')}) between 9 and 15",
    }
    for kind, (gate, pattern) in _BASE.items():
        df = _located(df, f"_{kind}", gate, pattern)
        df = df.withColumn(f"_{kind}", F.expr(f"transform(filter(_{kind}, m -> {checks[kind]}), m -> named_struct('s', m.s, 'e', m.e, 'k', {KINDS.index(kind)}))"))
    return df.withColumn("base", F.array_sort(F.concat(*[f"_{k}" for k in _BASE]))).withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in _BASE}).drop(*[f"_{k}" for k in _BASE])


def _features() -> str:
    """SQL of the feature array of a candidate c (s, e, m, g, r, k)."""
    near = "lower(c.g)"
    secret = lambda x: f"IF(c.k = {KINDS.index('secret')}, {x}, 0D)"
    entropy = let("l", "split(left(c.m, 256), '')", "aggregate(array_distinct(l), 0D, (a, x) -> a - size(filter(l, y -> y = x)) * ln(size(filter(l, y -> y = x)) / size(l)) / size(l))")
    flag = lambda x: f"IF({x}, 1D, 0D)"
    count = lambda p: f"cast(regexp_count(c.m, r'{p}') as double)"
    return "array(" + ", ".join([
        "cast(c.k as double)",
        f"cast(char_length({_digits('c.m')}) as double)",
        count("[0-9]+"),
        count(r"[ ().\-/]"),
        flag("c.m like '%+%'"),
        flag(r"c.m rlike r'^\+?[0-9]{0,3}[ .-]?\([0-9]{2,5}\)'"),
        flag(r"c.m rlike r'^(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$'"),
        flag(r"c.m rlike r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$'"),
        flag(r"c.m rlike r'^[0-9]{4}[ .\-/][0-9]{4}[ .\-/][0-9]{4}[ .\-/][0-9]{1,7}$'"),
        flag(f"char_length({_digits('c.m')}) between 12 and 19 AND {_luhn(_digits('c.m'))}"),
        flag(f"""c.k = {KINDS.index('iban')} AND {_mod97("translate(c.m, ' ', '')")}"""),
        flag(f"{near} rlike r'(?:phone|tele?f?|tel\\.?|t[ée]l|call|mobile?|m[oó]vil|cell|fax|ruf|handy|whatsapp|sms)[^a-z0-9]*(?:(?:at|me|us|nr|no|number|is|on|:)[^a-z0-9]*)*$'"),
        flag(f"{near} rlike r'(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit)[^a-z0-9]*(?:(?:nr|no|number|is|:)[^a-z0-9]*)*$'"),
        flag(f"{near} rlike r'(?:ssn|social security|social)[^a-z0-9]*(?:(?:nr|no|number|is|:)[^a-z0-9]*)*$'"),
        flag(f"{near} rlike r'(?:order|invoice|isbn|issn|version|page|section|date|fig|serial|id|ref|part|sku|item|room|case|pp?\\.?|vol|total|sum|about|year|from|to)[^a-z0-9]*(?:(?:nr|no|number|is|#|:)[^a-z0-9]*)*$'"),
        flag(r"c.m rlike r'^(?:[12][0-9]{3}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][12][0-9]{3})'"),
        "cast(coalesce(try_cast(substr(c.m, 1, 1) as int), 10) as double)",
        flag(r"c.m rlike r'[\[({<] ?(?:dot|DOT) ?[\])}>]|\.'"),
        flag(r"c.r rlike r'^ ?(?:[%€$£°]|(?:kg|km|cm|mm|euros?|dollars?|usd|eur|pages?|times|years?)\b)'"),
        secret(entropy),
        secret("cast(least(char_length(c.m), 200) as double)"),
        secret("cast(regexp_count(c.m, r'[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z][a-z]') as double)"),
        secret(flag(r"c.m rlike r'^(?:[0-9a-f]+|[0-9A-F]+)$'")),
        secret(flag(r"c.m rlike r'^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ|-----BEGIN)'")),
        secret(flag(r"c.m rlike r'[=:]'")),
        secret(flag(r"c.m rlike r'[A-Za-z]{5}[_/-][A-Za-z0-9]|[_/-][A-Za-z]{5}'")),
        secret(flag(f"""{near} rlike r'(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|(?:api|access|secret|private|auth)[_ -]?key|auth(?:orization)?|bearer|credentials?)[^a-z0-9]*(?:(?:is|was|bearer|:|=)[^a-z0-9]*)*$'""")),
        secret(flag(f"""{near} rlike r'(?:commit|sha-?(?:1|256|512)?|md5|hash|digest|checksum|uuid|etag|revision|rev|blob|object|file|image|version|build|see|page|id)[^a-z0-9]*$'""")),
        secret(flag(f"""{near} rlike r'[/.@?&#]$'""")),
        secret(flag("""c.r rlike r'^[./@?&][A-Za-z0-9]'""")),
        secret(flag(r"c.g rlike r'[=:][ \t]*[^A-Za-z0-9 ]?$'")),
    ]) + ")"


def _candidates(df: DataFrame) -> DataFrame:
    """Add ``cands``: proposed spans that overlap no base span as (s, e, k, f), f being their features."""
    for name, (gate, pattern, kinds) in _GENERATORS.items():
        df = _located(df, f"_{name}", gate, pattern)
        codes = ", ".join(str(KINDS.index(k)) for k in kinds)
        free = let("known", "base", f"filter(_{name}, m -> NOT exists(known, b -> b.s < m.e AND m.s < b.e))")
        df = df.withColumn(f"_{name}", F.expr(f"flatten(transform({free}, m -> transform(array({codes}), k -> named_struct('s', m.s, 'e', m.e, 'm', m.m, 'g', m.g, 'r', m.r, 'k', k))))"))
    df = df.withColumn("cands", F.concat(*[f"_{x}" for x in _GENERATORS])).drop(*[f"_{x}" for x in _GENERATORS])
    return df.withColumn("cands", F.expr(f"transform(cands, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'f', {_features()}))"))


def _training_texts(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Generated sentences with one number each: text, kind (-1: not personal), start, end."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def luhn(d: str, right: bool) -> str:
        total = sum(sum(divmod(int(x) * (2 - i % 2), 10)) for i, x in enumerate(reversed(d + "0"), 1))
        last = -total % 10
        return d + str(last if right else (last + r.randint(1, 9)) % 10)

    def iban(right: bool) -> str:
        body = num(18)
        check = 98 - int(body + "131400") % 97
        whole = f"DE{check if right else (check + r.randint(1, 90)) % 97 + 1:02d}{body}"
        return whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    area = lambda: r.choice("23456789") + num(2)
    near = {"phone": ["call", "phone:", "Tel.", "mobile", "fax", "my number is phone", "téléphone", "Handy"], "card": ["card", "visa", "credit card number:", "Karte"], "ssn": ["ssn", "SSN:", "social security number"]}
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: r.choice("abcxyz") + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 2)) + r.choice("0123456789")
    random_run = lambda: r.choice([hexed(32), hexed(40), hexed(40).upper(), hexed(64), mixed(r.randint(18, 44)), mixed(20) + "/" + mixed(19), mixed(24) + "-" + mixed(12)])
    other = ["order", "invoice no.", "isbn", "version", "serial number", "ref:", "case", "id", "in", "the", "total", "item #", "about", ""]
    out = []
    for _ in range(n):
        kind, before = -1, r.choice([*other, word(), word()])
        match r.randrange(23):
            case 0:
                kind, item = 3, r.choice([f"({area()}) {num(3)}-{num(4)}", f"{area()}-{num(3)}-{num(4)}", f"{area()}.{num(3)}.{num(4)}"])
            case 1:
                kind, before, item = 3, r.choice(near["phone"]), r.choice([f"0{num(9)}", f"0{num(2)} {num(7)}", f"{num(3)} {num(4)}", f"0{num(3)}/{num(6)}", f"{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}"])
            case 2:
                kind, before, item = 2, r.choice([*near["card"], word()]), r.choice("./").join([(d := luhn(r.choice("3456") + num(14), True))[:4], d[4:8], d[8:12], d[12:]])
            case 3:
                kind, before, item = 4, r.choice([*near["ssn"], word(), word()]), f"{num(3)}-{num(2)}-{num(4)}"
            case 4:
                kind, item = 5, iban(True)
            case 5:
                at, dot = r.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("{at}", "{dot}"), (" <at> ", ".")])
                kind, item = 0, f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'de', 'net'])}"
            case 6:
                item = iban(False)
            case 7 | 8:
                item = luhn(num(15), False)
            case 9:
                item = r.choice([f"{r.randint(1000, 2999)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}/{r.randint(10, 12)}/{r.randint(10, 28)} {num(2)}"])
            case 10:
                item = f"97{r.choice('89')}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"
            case 11:
                item = r.choice([num(k) for k in range(7, 19)])
            case 12:
                item = " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 8)))
            case 13:
                item = f"{num(r.randint(1, 4))}.{num(r.randint(4, 9))}"
            case 15 | 16:
                name = r.choice(["token", "TOKEN", "secret", "api_key", "apikey", "access_key", "password", "auth_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "private key", "Bearer", "credentials"])
                value = random_run()
                mark, quote = r.choice([" = ", "=", ": ", ": ", " "]), r.choice(['"', "'", "", '"'])
                kind, before, item = 6, (word() + " " if r.random() < 0.5 else "") + name + mark + quote, value + "\0" + quote
            case 17 | 22:
                kind, item = 6, r.choice([f"AKIA{mixed(18).upper()[2:]}", f"ghp_{mixed(36)}", f"sk-{mixed(40)}", f"xoxb-{num(11)}-{mixed(24)}", f"AIza{mixed(35)}", f"eyJ{mixed(30)}.eyJ{mixed(60)}.{mixed(43)}", "-----BEGIN {0}PRIVATE KEY-----\n{1}\n-----END {0}PRIVATE KEY-----".format(r.choice(["", "RSA ", "EC ", "OPENSSH "]), mixed(r.randint(6, 200)))])
            case 18:
                before, item = r.choice(["commit", "sha256:", "md5", "checksum", "revision", "digest:", "etag", "hash"]), r.choice([hexed(32), hexed(40), hexed(64)])
            case 19:
                before, item = r.choice(["see", "file", "uuid", "page", "", word(), "http://" + word() + ".org/" + word() + "/"]), r.choice(["-".join([hexed(8), hexed(4), hexed(4), hexed(4), hexed(12)]), f"{word()}-{word()}-{word()}-{word()}-{r.randint(1, 2030)}", f"{word()}_{word()}_{word()}_{num(4)}_{word()}", f"{r.randint(1990, 2030)}/{num(2)}/{num(2)}/{word()}-{word()}-{word()}", word() * 4 + num(2)])
            case 20:
                before, item = r.choice(["token", "secret", "password", "auth", "api key"]) + r.choice([": ", " = ", " is "]), r.choice([word() + word(), f"{word()} {word()}", "required " + word(), f"{word()}-{word()}"])
            case 21:
                before, item = r.choice([word(), "the"]), r.choice(["a" * r.randint(10, 30) + num(1), num(1) * r.randint(16, 40) + "x", f"{word()}{word()}{word()}{word()}{num(1)}"])
            case 14:
                item = ".".join(num(r.randint(1, 2)) for _ in range(r.randint(5, 7)))
            case _:
                item = f"{word()} (at) {word()} {word()}"
        left = " ".join(word() for _ in range(r.randint(2, 8))) + (" " + before if before else "") + ("" if before[-1:] in "=\"'/ " and before else " ")
        item, _, close = item.partition("\0")
        out.append((left + item + close + " " + " ".join(word() for _ in range(r.randint(1, 5))), kind, len(left), len(left) + len(item)))
    return out


_MODELS: dict = {}


def _model(spark: SparkSession, texts: int, seed: int) -> tuple[str, list[float]]:
    """SQL of a candidate's probability from ``c.f``, and each kind's threshold. Fitted once in a driver process."""
    if (texts, seed) not in _MODELS:
        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(_training_texts(texts, seed))], "i int, text string, kind int, a int, b int")
        found = _candidates(_base(rows)).select("i", F.explode("cands").alias("c"), "kind", "a", "b").select("i", "c.k", "c.f", F.expr("c.k = kind AND c.s < b AND a < c.e").alias("y")).orderBy("i", "c.k", "c.s").collect()
        x, y, k = np.array([r.f for r in found]), np.array([float(r.y) for r in found]), np.array([r.k for r in found])
        held = np.array([r.i % 3 == 0 for r in found])
        start, trees = fit(x[~held], y[~held], trees=48)
        z = start + sum(t.predict(x) for t in trees)
        a, b = calibrate(z[held], y[held])
        p = 1 / (1 + np.exp(-(a * z + b)))
        cuts = []
        for kind in range(len(KINDS)):
            own = np.append(np.sort(p[held & (k == kind)])[::-1], 0)
            hits = y[held & (k == kind)][np.argsort(-p[held & (k == kind)], kind="stable")]
            good = np.flatnonzero(np.cumsum(hits) >= 0.99 * np.arange(1, len(hits) + 1))
            cuts.append(max(0.5, float(own[good[-1] : good[-1] + 2].mean())) if len(good) else 2.0)
        total = " + ".join([f"{start!r}D", *(t.sql("c.f") for t in trees)])
        _MODELS[texts, seed] = f"1D / (1D + exp(-({a!r}D * ({total}) + {b!r}D)))", cuts
    return _MODELS[texts, seed]


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')")


def find_personal_data(docs: DataFrame, text_col: str = "text", *, training_texts: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """The input rows and columns with ``pii``: a struct of base and spans (arrays of s, e, k by start, then kind) and n_email, n_ip, n_card, n_phone.

    s and e count code points, e exclusive; k is the place in KINDS. spans holds all base spans and the selected candidates. Counts are of base spans.
    A null or empty text has none. Of selected candidates at the same place the most probable stays, then the first kind. Very long texts are searched whole. Rows are judged alone,
    so repeated rows and an empty table need no rule; input
    columns keep their names (an input column ``pii`` is replaced).
    """
    spark = docs.sparkSession
    prepare(spark)
    score, cuts = _model(spark, training_texts, seed)
    inner = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _candidates(_base(inner))
    one = "named_struct('s', c.s, 'e', c.e, 'k', c.k)"
    found = found.withColumn("cands", F.expr(f"transform(cands, c -> named_struct('p', {score}, 's', c.s, 'e', c.e, 'k', c.k))"))
    limits = ", ".join(f"{x!r}D" for x in cuts)
    found = found.withColumn("cands", F.expr(f"filter(cands, c -> c.p >= get(array({limits}), c.k))"))
    better = "o.s <= c.s AND c.e <= o.e AND (o.e - o.s > c.e - c.s OR o.p > c.p OR (o.p = c.p AND o.k < c.k))"
    found = found.withColumn("cands", F.expr(let("all", "array_distinct(cands)", f"transform(filter(all, c -> NOT exists(all, o -> {better})), c -> {one})")))
    spans = F.array_sort(F.concat("base", "cands"))
    order = "(x, y) -> CASE WHEN x.s <> y.s THEN sign(x.s - y.s) WHEN x.k <> y.k THEN sign(x.k - y.k) ELSE sign(x.e - y.e) END"
    found = found.withColumn("spans", spans).withColumns({c: F.expr(f"array_sort({c}, (x, y) -> cast(({order[10:]}) as int))") for c in ("base", "spans")})
    pii = F.struct("base", "spans", *[f"n_{k}" for k in _BASE])
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "pii"]
    return found.select(*kept, pii.alias("pii"))


def redacted(text_col: str = "text", pii_col: str = "pii") -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first. Null stays null."""
    merged = f"""aggregate({pii_col}.spans, cast(array() as array<struct<s: int, e: int, k: int>>), (a, x) -> IF(size(a) > 0 AND x.s < element_at(a, -1).e,
        concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'k', element_at(a, -1).k))), concat(a, array(x))))"""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    pieces = f"transform(m, (x, i) -> concat(substr({text_col}, coalesce(get(m, i - 1).e, 0) + 1, x.s - coalesce(get(m, i - 1).e, 0)), get({names}, x.k)))"
    whole = let("m", merged, f"concat(array_join({pieces}, ''), substr({text_col}, element_at(m, -1).e + 1))")
    return F.expr(f"CASE WHEN size({pii_col}.spans) > 0 THEN {whole} ELSE {text_col} END")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: id, base counts, the digest of base spans, all spans as text, and how many secrets and spans there are."""
    base = F.sha2(_joined("pii.base"), 256)
    return found.select(id_col, *[f"pii.n_{k}" for k in _BASE], base.alias("base_sha256"), _joined("pii.spans").alias("spans"), F.expr(f"cast(size(filter(pii.spans, x -> x.k = {KINDS.index('secret')})) as bigint)").alias("n_secret"), F.size("pii.spans").cast("long").alias("n_spans"))
