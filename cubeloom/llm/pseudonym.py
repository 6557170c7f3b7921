"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Private values are found by pattern, validated, and put through a keyed Feistel
network over their own format, so a card number becomes another valid card number, an
address another address, a date another date, and equal values stay equal in all
documents (a permutation: different values stay different).

    e-mail        letters and digits of the part before @, in any script (see below);
                  the domain stays
    card number   13 to 19 digits that pass the Luhn test; the last is made to pass
    IPv4          four numbers up to 255, as 32 bits
    phone         country code stays, all other digits change
    secret        32 or more hexadecimal digits with letters and digits; letters
                  stay letters, digits stay digits
    date          calendar dates of 1800 to 2199, written 2024-01-31, 31.01.2024 or
                  31/01/2024, permuted among the 146097 days of those 400 years

What does not validate stays as it is. Network: ROUNDS rounds, each shifts one half
by a stream of SHA-256 blocks seeded with key, format, round and the other half. ASCII letters and
digits are shifted inside their classes, letters and digits of other scripts inside
the alphabets of SCRIPTS or, outside these, inside their 64 code points.

The key is the caller's secret: who has it can undo the permutation.

Defined cases: null text stays null, with no finds; empty text stays. Null doc_ids
and repeated rows are treated as any other row. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Alphabets of other scripts as ranges of code points whose members are all letters
#: (Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul).
SCRIPTS = (
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F),
    (0x5D0, 0x5EA), (0x620, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
# Runs begin where nothing of their kind stands before and never give back what they
# took, so a long text is read once.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++(?<=[\p{L}\p{N}])@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+"
HEXADECIMAL = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
CARD = r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PRIVATE = "|".join(f"(?:{p})" for p in (EMAIL, HEXADECIMAL, IPV4, PHONE, DATE, CARD))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def alphabets() -> list[tuple[int, int]]:
    """SCRIPTS and what they leave of the blocks of 64 code points that they touch: with
    the other blocks these are apart and cover all, so a shift inside each is undone by
    a shift back."""
    out = sorted(SCRIPTS)
    blocks = sorted({b for low, high in SCRIPTS for b in range(low // 64, high // 64 + 1)})
    inside = {c for low, high in SCRIPTS for c in (*range(low, min(high, low + 64) + 1), *range(max(low, high - 64), high + 1))}
    for b in blocks:
        if any(low <= b * 64 and b * 64 + 63 <= high for low, high in SCRIPTS):
            continue
        free = [c for c in range(b * 64, b * 64 + 64) if c not in inside]
        begin = [c for c in free if c - 1 not in free]
        out += [(c, next(e for e in range(c, b * 64 + 65) if e + 1 not in free)) for c in begin]
    return sorted(out)


def _shift(chars: str, other: str, key: str, kind: str, letters: int, wide: bool) -> str:
    """chars (array) shifted inside their classes by a stream of the other half."""
    seed = f"sha2(concat({_text(key)}, '{kind}', ':', r, ':', array_join({other}, '')), 256)"
    blocks = _let("seed", seed, "transform(sequence(0, size(%s) div 12), b -> sha2(concat(seed, ':', b), 256))" % chars)
    noise = "cast(conv(substring(blocks[i div 12], (i % 12) * 5 + 1, 5), 16, 10) as int)"
    point = "ascii(c)"
    moved = " ".join(f"when {point} between {low} and {high} then {low} + ({point} - {low} + {noise}) % {high - low + 1}" for low, high in alphabets())
    beyond = f"when {point} > 127 then decode(unhex(lpad(hex(case {moved} else {point} - {point} % 64 + ({point} % 64 + {noise}) % 64 end), 8, '0')), 'UTF-32')" if wide else ""
    return _let(
        "blocks", blocks,
        f"transform({chars}, (c, i) -> case when c between '0' and '9' then char(48 + ({point} - 48 + {noise}) % 10)"
        f" when c between 'a' and 'z' then char(97 + ({point} - 97 + {noise}) % {letters})"
        f" when c between 'A' and 'Z' then char(65 + ({point} - 65 + {noise}) % {letters}) {beyond} else c end)",
    )


def permuted(value: str, kind: str, key: str, letters: int = 26, wide: bool = False) -> str:
    """SQL for a string permuted within its shape: ASCII letters and digits move, with
    `wide` those of other scripts too; the rest stays."""
    left, right = (_shift(a, b, key, kind, letters, wide) for a, b in (("s.l", "s.r"), ("s.r", "s.l")))
    net = f"aggregate(sequence(1, {ROUNDS}), struct(slice(v, 1, size(v) div 2) as l, slice(v, size(v) div 2 + 1, size(v)) as r), (s, r) -> if(r % 2 = 1, struct({left} as l, s.r as r), struct(s.l as l, {right} as r)), s -> concat(array_join(s.l, ''), array_join(s.r, '')))"
    return _let("v", f"split({value}, '')", net)


def _number_net(first: int, second: int, key: str, kind: str) -> str:
    """SQL for n, a number below first * second, permuted by an unbalanced network."""
    noise = f"cast(conv(substring(sha2(concat({_text(key)}, '{kind}', ':', r, ':', if(r % 2 = 1, s.b, s.a)), 256), 1, 12), 16, 10) as bigint)"
    return f"aggregate(sequence(1, {ROUNDS}), struct(n div {second}L as a, n % {second}L as b), (s, r) -> if(r % 2 = 1, struct((s.a + {noise}) % {first}L as a, s.b as b), struct(s.a as a, (s.b + {noise}) % {second}L as b)), s -> s.a * {second}L + s.b)"


def _filled(shape: str, digits: str) -> str:
    """shape with its digits replaced, one by one, by those of `digits`."""
    return f"aggregate(split({shape}, ''), struct('' as t, 1 as k), (a, c) -> if(c between '0' and '9', struct(concat(a.t, substring({digits}, a.k, 1)) as t, a.k + 1 as k), struct(concat(a.t, c) as t, a.k as k)), a -> a.t)"


def _luhn(digits: str, skip: int) -> str:
    """The Luhn sum of a digit string; skip 1: as if a check digit followed."""
    d = "(ascii(c) - 48)"
    return f"aggregate(transform(reverse(split({digits}, '')), (c, i) -> if((i + {skip}) % 2 = 0, {d}, {d} * 2 div 10 + {d} * 2 % 10)), 0L, (t, x) -> t + x)"


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of a match; the match itself where it does not validate."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat({permuted(f'''substring_index({m}, '@', 1)''', 'email', key, wide=True)}, '@', substring_index({m}, '@', -1))"
    secret = f"if({m} rlike '[0-9]' and {m} rlike '[A-Fa-f]', {permuted(m, 'secret', key, 6)}, {m})"
    packed = f"aggregate(split({m}, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))"
    address = _let("n", packed, _let("n", _number_net(65536, 65536, key, "ip"), "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)"))
    code = f"regexp_extract({m}, '^([+][0-9]{{1,3}})(?:[ .(-]|$)', 1)"
    phone = _let("h", f"if({m} rlike '^[+]', if({code} = '', substring({m}, 1, 2), {code}), '')", f"concat(h, {_let('t', f'substring({m}, length(h) + 1)', _filled('t', permuted('''regexp_replace(t, '[^0-9]', '')''', 'phone', key)))})")
    body = f"substring({digits}, 1, length({digits}) - 1)"
    made = _let("b", permuted(body, "card", key), f"concat(b, cast((10 - {_luhn('b', 1)} % 10) % 10 as string))")
    card = f"if({_luhn(digits, 0)} % 10 = 0, {_let('w', made, _filled(m, 'w'))}, {m})"
    split_date = f"if({m} rlike '^[0-9]{{4}}', {m}, concat(substring({m}, 7, 4), '-', substring({m}, 4, 2), '-', substring({m}, 1, 2)))"
    net = _let("n", "cast(datediff(y, date'1800-01-01') as bigint)", _number_net(27, 5411, key, "date"))
    new = _let("z", f"date_format(date_add(date'1800-01-01', cast({net} as int)), 'yyyy-MM-dd')", f"if({m} rlike '^[0-9]{{4}}', z, concat(substring(z, 9, 2), substring({m}, 3, 1), substring(z, 6, 2), substring({m}, 3, 1), substring(z, 1, 4)))")
    date = _let("y", f"try_to_timestamp({split_date}, 'yyyy-MM-dd')", f"if(y is null or year(y) not between 1800 and 2199, {m}, {new})")
    return (
        f"case when {m} like '%@%' then {email} when {m} rlike '^[0-9A-Fa-f]{{32,}}$' then {secret} when {m} rlike '^{_OCTET}([.]{_OCTET}){{3}}$' then {address}"
        f" when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}})$' then {date} when {m} rlike '^[+(]' then {phone} else {card} end"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", into: str | None = None, count: str | None = None) -> DataFrame:
    """docs with text_col (or the column `into`) pseudonymised and, if named, the
    number of changed values in `count`. Texts without a digit or @ are not searched."""
    text, own = f"`{text_col}`", "_private"
    while any(c.lower().startswith(own) for c in docs.columns):  # no clash with the table's columns
        own += "_"
    found, new, whole = f"{own}found", f"{own}new", f"{own}text"
    search = F.expr(f"if({text} rlike '[0-9@]', regexp_extract_all({text}, {_text(PRIVATE)}, 0), cast(array() as array<string>))")
    full = docs.withColumn(found, search).withColumn(new, F.expr(f"if(size({found}) > 0, transform({found}, m -> {pseudonym('m', key)}), {found})"))
    full = full.withColumn(whole, F.expr(f"if(size({found}) > 0, array_join(zip_with(split({text}, {_text(PRIVATE)}, -1), concat({new}, array('')), (a, b) -> concat(a, b)), ''), {text})"))
    if count:
        full = full.withColumn(count, F.expr(f"cast(coalesce(aggregate(zip_with({found}, {new}, (a, b) -> if(a = b, 0, 1)), 0, (s, x) -> s + x), 0) as int)"))
    return full.withColumn(into or text_col, F.col(whole)).drop(found, new, whole)
