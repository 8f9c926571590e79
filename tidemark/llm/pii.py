r"""Format-preserving pseudonyms for personal data, with SQL expressions only.

Candidates are found by one pattern and validated: card numbers by Luhn's check digit, IPv4 addresses by their
octets, dates by the calendar. A value is permuted inside its own format by a keyed Feistel network over the
product of two ranges a x b (ten rounds, each adding a keyed hash of the one half to the other, modulo a or b):
a bijection, so equal values stay equal over all documents and different ones stay different.

* card: the digits before the check digit, 10^u x 10^v, then a new check digit;
* phone: the digits after the country code (ten in North America, 10^5 x 10^5); country code and punctuation stay;
* ssn: nine digits, 10^4 x 10^5;
* ipv4: 2^16 x 2^16; where an octet is written with leading zeros its pseudonym has the same width at least;
* date (YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY): the day's number in the 146097 = 189 x 773 days of the Gregorian
  cycle 1800-2199; other years stay;
* email: no number, so its address becomes a keyed hash under a reserved domain.

The key is a one-row table that expressions read as a scalar subquery, so that plans and event logs don't show it.

Defined cases: null text stays null, with counts 0; values that fail validation stay as they are; rows are
handled one by one; columns that bear the names of results are replaced, others pass through. A value and
its pseudonym may by chance be equal; it is counted all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "phone", "card", "ssn", "ipv4", "date")

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: Ten digits as in North America, or a country code and two to five groups.
PHONE = r"(?<![\d.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?)(?:[ .-]\d{2,4}){1,4}(?!\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
PATTERN = "|".join((EMAIL, PHONE, DATE, SSN, IPV4, CARD))


def _text(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def feistel(x: str, a: str, b: str, key: str, tweak: str, rounds: int = ROUNDS) -> str:
    """SQL for the keyed permutation of x in [0, a * b)."""
    half = lambda v: f"cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, cast(i as string), cast({v} as string)), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {int(rounds)}), named_struct('l', ({x}) div ({b}), 'r', ({x}) % ({b})), (s, i) -> if(i % 2 = 1, "
        f"named_struct('l', (s.l + {half('s.r')} % ({a})) % ({a}), 'r', s.r), named_struct('l', s.l, 'r', (s.r + {half('s.l')} % ({b})) % ({b}))), s -> s.l * ({b}) + s.r)"
    )


def _ten(n: str) -> str:
    return f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"


def _luhn_sum(digits: str, doubled: int) -> str:
    """Sum of digits, from the last on, every second doubled; doubled 0: the last one first."""
    d = f"cast(substr({digits}, -(i + 1), 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (t, i) -> t + if(i % 2 = {doubled}, ({d} * 2) div 10 + ({d} * 2) % 10, {d}))"


def _into(template: str, digits: str) -> str:
    """The template with its digits replaced, in order."""
    return f"array_join(transform(split({template}, ''), (c, j) -> if(c rlike '[0-9]', substr({digits}, length(regexp_replace(substr({template}, 1, j + 1), '[^0-9]', '')), 1), c)), '')"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _permuted(digits: str, key: str, tweak: str) -> str:
    """A digit string permuted among those of its length (18 at most)."""
    u = f"(length({digits}) div 2)"
    return f"lpad(cast({feistel(f'cast({digits} as bigint)', _ten(u), _ten(f'(length({digits}) - {u})'), key, tweak)} as string), length({digits}), '0')"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym(m: str, key: str) -> str:
    """SQL for a struct (kind, value): kind is null if m fails validation."""
    as_is = f"named_struct('kind', cast(null as string), 'value', {m})"
    of = lambda kind, value: f"named_struct('kind', '{kind}', 'value', {value})"
    email = of("email", f"concat('u', substr(sha2(concat_ws('|', {key}, 'email', lower({m})), 256), 1, 16), '@', substr(sha2(concat_ws('|', {key}, 'domain', lower(substring_index({m}, '@', -1))), 256), 1, 8), '.invalid')")
    rest = f"regexp_replace({m}, '^[+][0-9]{{1,3}}[ .-]?', '')"
    phone = of("phone", _let("w", rest, f"concat(substr({m}, 1, length({m}) - length(w)), {_let('q', _permuted(_digits('w'), key, repr('phone')), _into('w', 'q'))})"))
    ssn = of("ssn", _let("q", _permuted(_digits(m), key, "'ssn'"), _into(m, "q")))
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    number = feistel("p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3]", "65536", "65536", key, "'ipv4'")
    ipv4 = _let("p", octets, f"if(array_max(p) > 255, {as_is}, " + of("ipv4", _let("y", number, f"array_join(transform(array(y div 16777216, y div 65536 % 256, y div 256 % 256, y % 256), (o, j) -> if(split({m}, '[.]')[j] like '0_%', lpad(cast(o as string), greatest(3, length(split({m}, '[.]')[j])), '0'), cast(o as string))), '.')")) + ")")
    form = f"case when substr({m}, 5, 1) = '-' then 'yyyy-MM-dd' when substr({m}, 5, 1) = '/' then 'yyyy/MM/dd' else 'dd.MM.yyyy' end"
    iso = f"case when substr({m}, 5, 1) = '-' then {m} when substr({m}, 5, 1) = '/' then replace({m}, '/', '-') else concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) end"
    moved = feistel("datediff(d, date'1800-01-01')", "189L", "773L", key, "'date'")
    date = _let("d", f"try_cast({iso} as date)", f"if(d is null or year(d) not between 1800 and 2199, {as_is}, " + of("date", f"date_format(date_add(date'1800-01-01', cast({moved} as int)), {form})") + ")")
    payload = _let("v", _permuted("substr(w, 1, length(w) - 1)", key, "'card'"), f"concat(v, cast((10 - {_luhn_sum('v', 0)} % 10) % 10 as string))")
    card = _let("w", _digits(m), f"if({_luhn_sum('w', 1)} % 10 <> 0, {as_is}, " + of("card", _let("q", payload, _into(m, "q"))) + ")")
    return (
        f"case when {m} like '%@%' then {email} when {m} rlike '^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[ .-][0-9]{{4}}$' then {phone} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {ipv4} "
        f"when length({m}) = 10 and {m} rlike '^[0-9]{{4}}[-/]|^[0-9]{{2}}[.]' then {date} else {card} end"
    )


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """docs with personal data in text replaced, and n_<kind> for each kind."""
    names = [f"n_{k}" for k in KINDS]
    secret = "_td_key"
    docs = docs.drop(*names).withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    has = F.col(text).rlike(PATTERN)
    found = F.when(has, F.expr(f"transform(regexp_extract_all(`{text}`, {_text(PATTERN)}, 0), m -> {pseudonym('m', secret)})"))
    marked = docs.withColumn("_td_found", found)
    new = F.expr(f"array_join(zip_with(split(`{text}`, {_text(PATTERN)}, -1), _td_found, (p, o) -> concat(p, coalesce(o.value, ''))), '')")
    counts = {f"n_{k}": F.coalesce(F.expr(f"size(filter(_td_found, o -> o.kind = '{k}'))"), F.lit(0)).cast("long") for k in KINDS}
    counts = {n: F.greatest(c, F.lit(0)) for n, c in counts.items()}
    return marked.withColumns({text: F.when(F.col("_td_found").isNotNull(), new).otherwise(F.col(text)), **counts}).drop("_td_found", secret)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "tidemark-demo-key")
