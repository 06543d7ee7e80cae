"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates in whole texts: e-mail addresses, IPv4 and IPv6
addresses, telephone numbers, payment card numbers, social security numbers,
account numbers (IBAN), dates and secrets behind a key word. Numbers and dates
are validated (Luhn digit, octets up to 255, mod-97, calendar); what fails
stays as it is. A valid value is permuted within its format by a keyed
Feistel network, so equal values get equal pseudonyms in every document and
different values different ones, separators stay (and lengths, but for IPv4
octets), and pseudonyms of cards, addresses, IBANs and dates are valid again:

    card      all digits but the last are permuted, the last is a new Luhn digit
    IPv4      octets as digits of two halves in base 256
    phone     the digits of the subscriber (all but a leading +country code)
    IPv6      the hexadecimal digits, group by group
    SSN       all nine digits, to a number that can be given out
    IBAN      the digits after the check digits; new check digits
    date      the day's number in a cycle of 400 years (1800-2199), 27 x 5411
    e-mail    letters and digits of the local part and the domain's labels but the
              last, each class by itself
    secret    behind a key word (token, secret, ...): 16 or more hexadecimal digits
              among themselves; else, of 8 or more characters with a digit,
              letters and digits each by themselves

Dates are year-month-day (with - or /, also before the T of a time),
month/day/year and, where that is no date, day/month/year (with / or -),
day.month.year, and with an English month's name before or behind the day.
A day has the same pseudonym in each of them; day/month/year dates (their
day is over 12) move on until their day is over 12 again, so that no two
dates get one text. A name keeps its case and whether it is cut short.

A value is a sequence of digits in mixed or single base split in two halves;
a round adds to one half a keyed hash (SHA-256 of key, format, round and the
other half) modulo that half's size, so each round, and with it the whole,
is a bijection of the format. The text between the findings is kept byte for
byte: the text is split at the pattern and joined again with the pseudonyms.

The key is part of the SQL expressions, so plans and event logs show it: set
``spark.sql.redaction.string.regex`` to its pattern, or keep them as safe as
the key.

Scale: a narrow map; no shuffle, no Python. Findings are handled one by one
within their row, never collected.

Defined results: a NULL text stays NULL, an empty one empty; other columns,
whatever their names, pass through unchanged; repeated rows are treated
alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_KEYWORD = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)"

# One alternative per format; the order decides where two could begin at one place.
PATTERN = (
    # runs are possessive and begin at a run's first character: no length is capped, none is read twice
    r"(?i:(?<![a-z0-9._%+-])[a-z0-9._%+-]++@[a-z0-9-]++(?:\.[a-z0-9-]++)++)"
    r"|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?!-[0-9]|(?![Tt][0-9]{2}[:0-9])[0-9A-Za-z])"
    r"|(?<![0-9A-Za-z/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?!/[0-9]|(?![Tt][0-9]{2}[:0-9])[0-9A-Za-z])"
    r"|(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z]|/[0-9])"
    r"|(?<![0-9A-Za-z-])[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
    r"|(?<![0-9A-Za-z.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
    rf"|(?i:(?<![0-9a-z])[0-9]{{1,2}}[ -]{_MONTH}(?:\.?,? |-)[0-9]{{4}}(?![0-9a-z]))"
    rf"|(?i:(?<![0-9a-z]){_MONTH}\.? [0-9]{{1,2}},? [0-9]{{4}}(?![0-9a-z]))"
    r"|(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
    r"|(?<![0-9A-Za-z]|[0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9A-Za-z]| [0-9])"
    r"|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
    r"|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"
    r"|(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
    rf"|(?i:(?<![a-z0-9]){_KEYWORD}[\"']?\s{{0,4}}[=:]\s{{0,4}}[\"']?(?:[0-9a-f]{{16,}}+(?![0-9a-z+/_=-])|(?=[a-z+/_=-]*+[0-9])[0-9a-z+/_=-]{{8,}}+))"
)
#: A cheap look before the pattern: every format but e-mail, IPv6 and secrets has two digits close together.
HINT = rf"@|[0-9].{{0,3}}[0-9]|[0-9A-Fa-f]:|(?i:{_KEYWORD})"
ROUNDS = 8


def _hash(key: str, what: str, round_no: str, other: str, modulus: str) -> str:
    """Keyed hash below ``modulus``: 60 bits of SHA-256."""
    return (f"pmod(cast(conv(substr(sha2(concat('{key}', '|{what}|', cast({round_no} as string), '|', "
            f"cast({other} as string)), 256), 1, 15), 16, 10) as bigint), {modulus})")


def _feistel(key: str, what: str, left: str, right: str, size_l: str, size_r: str) -> str:
    """SQL struct (l, r) of the permuted halves; sizes below 2^60."""
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
            f"if(i % 2 = 1, named_struct('l', pmod(s.l + {_hash(key, what, 'i', 's.r', size_l)}, {size_l}), 'r', s.r), "
            f"named_struct('l', s.l, 'r', pmod(s.r + {_hash(key, what, 'i', 's.l', size_r)}, {size_r}))))")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(key: str, what: str, digits: str) -> str:
    """Permutation of a string of 2 to 34 decimal digits, its length kept.
    The format's name carries the length, so each length has its own."""
    half = f"cast(length({digits}) div 2 as int)"
    rest = f"(length({digits}) - {half})"
    pow10 = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    tag = f"{what}', cast(length({digits}) as string), '"
    return _let("h", _feistel(key, tag, f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", pow10(half), pow10(rest)),
                f"concat(lpad(cast(h.l as string), {half}, '0'), lpad(cast(h.r as string), {rest}, '0'))")


def _refill(shape: str, pattern: str, fill: str) -> str:
    """``shape`` with the characters that match ``pattern`` replaced by those
    of ``fill``, one after the other."""
    return (f"aggregate(sequence(1, length({shape})), named_struct('o', '', 'k', 1), (s, i) -> "
            f"if(substr({shape}, i, 1) rlike '{pattern}', "
            f"named_struct('o', concat(s.o, substr({fill}, s.k, 1)), 'k', s.k + 1), "
            f"named_struct('o', concat(s.o, substr({shape}, i, 1)), 'k', s.k))).o")


def _only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn_sum(digits: str, doubled: int) -> str:
    """Sum of a Luhn check; ``doubled``: parity, from the right, of the places that count double."""
    at = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return (f"aggregate(sequence(0, length({digits}) - 1), 0L, (a, i) -> a + if(i % 2 = {doubled}, "
            f"(2 * {at}) div 10 + (2 * {at}) % 10, {at}))")


def _card(key: str) -> str:
    inner = _let("p", _digits(key, "card", "substr(d, 1, length(d) - 1)"),
                 _refill("m", "[0-9]", f"concat(p, cast((10 - {_luhn_sum('p', 0)} % 10) % 10 as string))"))
    return _let("d", _only_digits("m"), f"if(length(d) between 13 and 19 and {_luhn_sum('d', 1)} % 10 = 0 and not d rlike '^0+$', {inner}, m)")


def _ip(key: str) -> str:
    oct_ = [f"cast(split(m, '[.]')[{i}] as int)" for i in range(4)]
    valid = " and ".join(f"{o} <= 255" for o in oct_)
    halves = _feistel(key, "ip", f"{oct_[0]} * 256 + {oct_[1]}", f"{oct_[2]} * 256 + {oct_[3]}", "65536L", "65536L")
    out = "concat(h.l div 256, '.', h.l % 256, '.', h.r div 256, '.', h.r % 256)"
    return f"if({valid}, {_let('h', halves, out)}, m)"


def _moved(key: str, n: str) -> str:
    """The pseudonym of a day's number."""
    return _let("h", _feistel(key, "date", f"{n} div 5411", f"{n} % 5411", "27L", "5411L"), "h.l * 5411 + h.r")  # 27 x 5411 days in 400 years


def _day(key: str, iso: str, out: str, otherwise: str = "m", later: bool = False) -> str:
    """``out``, over the new date ``t``, if ``iso`` is a date; ``later``:
    moved on until the day is over 12."""
    date = "date_add(date'1800-01-01', cast({} as int))".format
    new = _moved(key, "n")
    if later:  # the chance that none of 64 has such a day is below 1e-24
        new = (f"aggregate(sequence(1, 64), named_struct('n', cast({new} as bigint)), (s, i) -> if(day({date('s.n')}) > 12, s, "
               f"named_struct('n', cast({_moved(key, 's.n').replace('(s, i)', '(s2, i2)').replace('s.l', 's2.l').replace('s.r', 's2.r').replace('i %', 'i2 %').replace('cast(i as', 'cast(i2 as')} as bigint)))).n")
    return _let("n", f"datediff(try_to_date({iso}, 'yyyy-MM-dd'), date'1800-01-01')",
                f"if(n between 0 and 146096, {_let('t', date(new), out)}, {otherwise})")


def _date(key: str) -> str:
    return _day(key, "replace(m, '/', '-')", "concat_ws(substr(m, 5, 1), date_format(t, 'yyyy'), date_format(t, 'MM'), date_format(t, 'dd'))")


def _numbers_date(key: str) -> str:
    """Day and month in either order before the year; a number of one digit
    has as many as it needs, one of two has two."""
    two = "lpad({}, 2, '0')".format
    number = lambda what, i: f"if(length(p[{i}]) = 2, {two(f'cast({what}(t) as string)')}, cast({what}(t) as string))"
    sign = "regexp_extract(m, '[./-]', 0)"
    day_first = dict(iso=f"concat_ws('-', p[2], {two('p[1]')}, {two('p[0]')})", out=f"concat_ws({sign}, {number('day', 0)}, {number('month', 1)}, date_format(t, 'yyyy'))")
    month_first = dict(iso=f"concat_ws('-', p[2], {two('p[0]')}, {two('p[1]')})", out=f"concat_ws({sign}, {number('month', 0)}, {number('day', 1)}, date_format(t, 'yyyy'))")
    return _let("p", "split(m, '[./-]')", f"if({sign} = '.', {_day(key, **day_first)}, "
                + _day(key, **month_first, otherwise=_day(key, **day_first, later=True)) + ")")


def _named_date(key: str) -> str:
    names = "array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")"
    month = f"lpad(cast(array_position(transform({names}, x -> substr(x, 1, 3)), lower(substr(w, 1, 3))) as string), 2, '0')"
    iso = f"concat_ws('-', regexp_extract(m, '[0-9]{{4}}$', 0), {month}, lpad(d, 2, '0'))"
    # a name longer than its first letters (june, not sept) is whole
    whole = _let("x", f"element_at({names}, month(t))", f"if(array_contains({names}, lower(w)) and lower(w) <> 'may', x, substr(x, 1, 3))")
    name = _let("z", whole, "CASE WHEN w = upper(w) THEN upper(z) WHEN w = lower(w) THEN z ELSE initcap(z) END")
    day = "lpad(cast(day(t) as string), greatest(length(d), length(cast(day(t) as string))), '0')"
    out = (f"concat(if(m rlike '^[0-9]', concat({day}, substr(m, length(d) + 1, 1), {name}), "
           f"concat({name}, regexp_extract(m, '^[A-Za-z]+([^0-9]+)', 1), {day})), "
           "regexp_extract(m, '([^0-9A-Za-z]+)[0-9]{4}$', 1), date_format(t, 'yyyy'))")
    return _let("w", "regexp_extract(m, '[A-Za-z]+', 0)", _let("d", "regexp_extract(m, '[0-9]+', 0)", _day(key, iso, out)))


def _phone(key: str) -> str:
    """All digits but those of a leading country code (those behind + up to a
    separator; without one the first digit)."""
    head = r"regexp_extract(m, '^[+](?:[0-9]{1,3}(?=[ .(-])|[0-9])', 0)"
    return _let("c", head, _let("t", "substr(m, length(c) + 1)", _let(
        "d", _only_digits("t"), f"if(length(c) + length(d) between 7 and 18 and length(d) >= 4, "
        f"concat(c, {_let('p', _digits(key, 'phone', 'd'), _refill('t', '[0-9]', 'p'))}), m)")))


def _mod97(text: str) -> str:
    """Remainder of an IBAN, its first four characters moved behind, by 97."""
    t = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    value = "if(substr(y, i, 1) rlike '[0-9]', (a * 10 + cast(substr(y, i, 1) as int)) % 97, (a * 100 + ascii(substr(y, i, 1)) - 55) % 97)"
    return _let("y", t, f"aggregate(sequence(1, length(y)), 0, (a, i) -> {value})")


def _iban(key: str) -> str:
    body = "substr(u, 5)"
    new = _let("b", _let("q", _only_digits(body), f"if(length(q) < 2, {body}, {_let('p', _digits(key, 'iban', 'q'), _refill(body, '[0-9]', 'p'))})"),
               _let("z", f"lpad(cast(98 - {_mod97("concat(substr(u, 1, 2), '00', b)")} as string), 2, '0')",
                    _refill("m", "[0-9A-Z]", "concat(substr(u, 1, 2), z, b)")))
    return _let("u", "regexp_replace(m, ' ', '')", f"if(length(u) between 15 and 34 and {_mod97('u')} = 1, {new}, m)")


def _alphabet(key: str, what: str, x: str, letters: str) -> str:
    """Keyed permutation of a string over one alphabet, length and all-upper
    or all-lower case kept (mixed case by place): each half's characters move by keyed amounts that depend on the other
    half, in turn."""
    n = len(letters)
    fold = f"lower({x})"
    half = f"cast(greatest(1, length({x}) div 2) as int)"

    def moved(part: str, other: str) -> str:
        # enough hash digits for one amount per character
        digest = f"sha2(concat('{key}', '|{what}|', cast(i as string), '|', {other}), 256)"
        amount = f"cast(conv(substr({digest}, 1 + 2 * ((k - 1) % 32), 2), 16, 10) as int) + 7 * cast((k - 1) div 32 as int)"
        place = f"(instr('{letters}', substr({part}, k, 1)) - 1 + {amount}) % {n} + 1"
        return (f"if(length({part}) = 0, '', array_join(transform(sequence(1, greatest(1, length({part}))), "
                f"k -> substr('{letters}', {place}, 1)), ''))")

    state = (f"aggregate(sequence(1, 4), named_struct('l', substr({fold}, 1, {half}), 'r', substr({fold}, {half} + 1)), (s, i) -> "
             f"if(i % 2 = 1, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')})))")
    joined = _let("g", state, "concat(g.l, g.r)")
    case = (f"CASE WHEN {x} = upper({x}) THEN upper(w) WHEN {x} = lower({x}) THEN w ELSE array_join(transform(sequence(1, length({x})), "
            f"k -> if(substr({x}, k, 1) rlike '[A-Z]', upper(substr(w, k, 1)), substr(w, k, 1))), '') END")
    return f"if(length({x}) = 0, '', {_let('w', joined, case)})"


def _chunks(x: str, size: int, body: str) -> str:
    """``body`` over ``part``, each run of ``size`` characters of a string:
    the work on a long value grows with its length only."""
    return f"array_join(transform(sequence(1, length({x}), {size}), z -> {_let('part', f'substr({x}, z, {size})', body)}), '')"


def _by_class(key: str) -> str:
    """An address but the last label of its domain, or a secret that is not
    hexadecimal: letters among letters and digits among digits; the
    separators stay."""
    letters = _let("v", "regexp_replace(part, '[^A-Za-z]', '')", _alphabet(key, "email", "v", "abcdefghijklmnopqrstuvwxyz"))
    digits = _let("d", _only_digits("part"), f"if(length(d) = 0, '', {_alphabet(key, 'email-digits', 'd', '0123456789')})")
    part = _let("f", letters, _let("q", digits, _refill(_refill("part", "[A-Za-z]", "f"), "[0-9]", "q")))
    rest = "if(m rlike '@', regexp_extract(m, '^(.*)[.][^.]+$', 1), substr(m, length(g) + 1))"
    return _let("g", LEAD, _let("e", rest, f"concat(g, {_chunks('e', 64, part)}, substr(m, length(g) + length(e) + 1))"))


#: What stands before a secret, nothing where there is no key word.
LEAD = r"regexp_extract(m, '^[^=:@]*[A-Za-z][\"\']?\\s{0,4}[=:]\\s{0,4}[\"\']?', 0)"


def _hexes(key: str) -> str:
    """A hexadecimal secret, or an IPv6 address, whose groups keep their
    lengths: the hexadecimal digits among themselves."""
    new = _chunks("d", 128, _alphabet(key, "secret", "part", "0123456789abcdef"))
    lead = f"if(m rlike '^[0-9A-Fa-f:]+$', '', {LEAD})"
    filled = _let("w", new, f"if(e rlike ':', {_refill('e', '[0-9A-Fa-f]', 'w')}, w)")
    return _let("g", lead, _let("e", "substr(m, length(g) + 1)", _let("d", "regexp_replace(e, ':', '')", f"concat(g, {filled})")))


def _ssn(key: str) -> str:
    """All nine digits, moved on until they are a number that can be given
    out again (an eighth are not: none of 64 in a row has a chance below 1e-57)."""
    ok = "not {0} rlike '^(000|666|9)' and substr({0}, 4, 2) <> '00' and substr({0}, 6) <> '0000'".format
    walked = f"aggregate(sequence(1, 64), '', (a, j) -> if(a <> '' and {ok('a')}, a, {_let('x', "if(a = '', n, a)", _digits(key, 'ssn', 'x'))}))"
    return _let("n", _only_digits("m"), f"if({ok('n')}, {_let('p', walked, _refill('m', '[0-9]', 'p'))}, m)")


def pseudonym_sql(key: str) -> str:
    """SQL expression over ``m``, one finding of PATTERN."""
    hexadecimal = "m rlike '^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$' or m rlike '[=:]\\\\s{0,4}[\"\\']?[0-9A-Fa-f]{16,}$'"
    return f"""CASE WHEN {hexadecimal} THEN {_hexes(key)}
      WHEN m rlike '[@=:]' THEN {_by_class(key)}
      WHEN m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {_ip(key)}
      WHEN m rlike '^[0-9]{{4}}(-[0-9]{{2}}-|/[0-9]{{2}}/)[0-9]{{2}}$' THEN {_date(key)}
      WHEN m rlike '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}$' THEN {_numbers_date(key)}
      WHEN m rlike '^[0-9]{{3}}[ -][0-9]{{2}}[ -][0-9]{{4}}$' THEN {_ssn(key)}
      WHEN m rlike '^[A-Z]{{2}}[0-9]{{2}}' THEN {_iban(key)}
      WHEN m rlike '^([0-9]{{1,2}}[ -])?[A-Za-z]{{3}}' THEN {_named_date(key)}
      WHEN m rlike '^[+(]' or m rlike '^[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' THEN {_phone(key)}
      ELSE {_card(key)} END"""


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pseudonymised(column: str, key: str) -> Column:
    """The text of ``column`` with every valid finding replaced: the parts
    between the findings and the pseudonyms, joined in turn."""
    if not key.isalnum():
        raise ValueError("the key must be letters and digits")
    text, pattern = f"`{column}`", _literal(PATTERN)
    mapped = f"transform(regexp_extract_all({text}, {pattern}, 0), m -> {pseudonym_sql(key)})"
    joined = f"array_join(zip_with(split({text}, {pattern}, -1), {mapped}, (b, p) -> concat(b, coalesce(p, ''))), '')"
    return F.expr(f"CASE WHEN {text} rlike {_literal(HINT)} AND {text} rlike {pattern} THEN {joined} ELSE {text} END")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the text pseudonymised."""
    return docs.withColumn(text_col, pseudonymised(text_col, key))
