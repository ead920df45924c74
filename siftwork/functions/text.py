"""String rules: public tokens, session ids, addresses and their masks, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the page's address check and of a session id, and the stars of a mask.
EMAIL = r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"
STARS = 6
RETRY_CAP = 600


def stripped(text: Column) -> Column:
    """Without white space at either end, Unicode's included; null stays null."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def stripped_or_empty(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit("")))


def length_between(text: Column, least: int, most: int) -> Column:
    """False for null."""
    return F.coalesce(F.char_length(text).between(least, most), F.lit(False))


def token_id(public: Column) -> Column:
    """The number before the first dot, null unless the token is "<id>.<secret>" with a secret.

    As a number counts what the application's language reads as one: decimal digits of any script, single underscores between
    digits, a sign, white space around.
    """
    parts = F.split(public, "[.]", 2)
    whole = (F.size(parts) == 2) & (F.try_element_at(parts, F.lit(2)) != "")
    number = stripped(F.try_element_at(parts, F.lit(1)))
    plain = F.when(number.rlike(r"\A[+-]?\p{Nd}+(?:_\p{Nd}+)*\z"), F.replace(number, F.lit("_"), F.lit("")))
    ascii_ = F.when(plain.rlike(r"\A[+-]?[0-9]+\z"), plain).otherwise(_digits(plain))
    return F.when(whole, ascii_.try_cast("bigint"))


#: The zeros of the decimal digits of other scripts; each is followed by its one to nine.
ZEROS = "\uff10\u0660\u06f0\u07c0\u0966\u09e6\u0a66\u0ae6\u0b66\u0be6\u0c66\u0ce6\u0d66\u0de6\u0e50\u0ed0\u0f20\u1040\u17e0\u1810"


def _digits(text: Column) -> Column:
    return F.translate(text, "".join(chr(ord(z) + i) for z in ZEROS for i in range(10)), "0123456789" * len(ZEROS))


def token_secret(public: Column) -> Column:
    """What follows the first dot, null where token_id() is null."""
    return F.when(token_id(public).isNotNull(), F.try_element_at(F.split(public, "[.]", 2), F.lit(2)))


def public_token(token: Column, secret: Column) -> Column:
    return F.concat(token.cast("string"), F.lit("."), secret)


def session_id(cookie: Column) -> Column:
    """The canonical lower-case form with dashes, null unless 32 hexadecimal digits are left.

    Before that urn: and uuid: go wherever they stand, braces at the ends, dashes everywhere.
    """
    plain = F.regexp_replace(F.replace(F.replace(cookie, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), r"\A[{}]+|[{}]+\z", "")
    digits = F.lower(F.replace(plain, F.lit("-"), F.lit("")))
    form = F.regexp_replace(digits, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike(r"\A[0-9a-f]{32}\z"), form)


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


# Bounds and alphabets of an address as the public validator documents them, and domains that never get mail.
LOCAL_MOST, LABEL_MOST, DOMAIN_MOST, ADDRESS_MOST, INPUT_MOST = 64, 63, 253, 254, 2048
_ATEXT = r"A-Za-z0-9!#$%&'*+\-/=?^_`{|}~"
_BEYOND = r"[\p{L}\p{N}\p{M}\p{P}\p{S}&&[^\x00-\x7F]]"
RESERVED = ("arpa", "invalid", "local", "localhost", "onion", "test")
#: A name may stand before an address in angle brackets.
_NAMED = r"""(?s)\A\s*(?:(?:[\w!#$%&'*+\-/=?^_`{|}~]+\s+)*[\w!#$%&'*+\-/=?^_`{|}~]+|"[^"]+")?\s*<(.+)>\s*\z"""


def bare_address(text: Column) -> Column:
    """The address of "Name <address>", or the text itself, without white space at the ends."""
    named = F.regexp_extract(text, "(?U)" + _NAMED, 1)
    return stripped(F.when(named != "", named).otherwise(text))


def is_server_email(text: Column) -> Column:
    """Whether the server takes the text as an address: a grammar of parts and labels, null is none.

    One @; before it up to 64 characters in parts joined by single dots; after it at least two labels of up to 63 letters, digits
    and inner hyphens, 253 in all, none with hyphens third and fourth but xn--, the last one ending in a letter, no reserved domain. Letters
    beyond ASCII are taken on both sides, not as the first of a part if they combine. At most 254 bytes.

    Not told apart as the validator does: what IDNA maps or refuses within a label (lengths count as written, xn-- labels
    are not decoded), normal forms, and dots of other scripts, which are no dots here.
    """
    address = bare_address(text)
    at = F.split(address, "@", -1)
    local, domain = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    atom = rf"(?:[{_ATEXT}]|{_BEYOND})"
    label = r"(?:[A-Za-z0-9]|[\p{L}\p{N}&&[^\x00-\x7F]])(?:(?:[A-Za-z0-9\-]|[\p{L}\p{N}\p{M}&&[^\x00-\x7F]])*(?:[A-Za-z0-9]|[\p{L}\p{N}\p{M}&&[^\x00-\x7F]]))?"
    labels = F.split(F.lower(domain), "[.]", -1)
    fits = lambda g: (F.char_length(g) <= LABEL_MOST) & (~g.rlike(r"\A..--") | g.startswith("xn--"))
    last = F.element_at(labels, -1)
    reserved = F.lower(domain).rlike(r"(?:\A|[.])(?:" + "|".join(RESERVED) + r")\z")
    good = (
        (F.char_length(text) <= INPUT_MOST)
        & (F.octet_length(address) <= ADDRESS_MOST)
        & (F.size(at) == 2)
        & local.rlike(rf"\A(?!\p{{M}}){atom}+(?:\.{atom}+)*\z")
        & (F.char_length(local) <= LOCAL_MOST)
        & domain.rlike(rf"\A{label}(?:\.{label})+\z")
        & (F.char_length(domain) <= DOMAIN_MOST)
        & F.forall(labels, fits)
        & last.rlike(r"[a-z]\z|[^\x00-\x7F]\z")
        & ~reserved
    )
    return F.coalesce(good, F.lit(False))


def is_email_loosely(text: Column) -> Column:
    """The first @ is neither the first nor the last character of the stripped text."""
    s = stripped_or_empty(text)
    place = F.instr(s, "@")
    return (place > 1) & (place < F.char_length(s))


def _masked(email: Column, shown: Column) -> Column:
    parts = F.split(F.coalesce(email, F.lit("")), "@", -1)
    local, domain = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    whole = (F.size(parts) == 2) & (local != "") & (domain != "")
    return F.when(whole, F.concat(shown, F.lit("*" * STARS + "@"), domain)).otherwise("")


def _local(email: Column) -> Column:
    return F.split_part(F.coalesce(email, F.lit("")), F.lit("@"), F.lit(1))


def mask_one(email: Column) -> Column:
    """First character, stars and domain; empty unless there is exactly one @ with text on both sides."""
    return _masked(email, F.substring(_local(email), 1, 1))


def mask_two(email: Column) -> Column:
    """As mask_one() with two characters; a shorter name is filled with stars."""
    return _masked(email, F.substring(F.concat(_local(email), F.lit("**")), 1, 2))


def sender(name: Column, address: Column) -> Column:
    return F.concat(name, F.lit(" <"), address, F.lit(">"))


def first_set(*values: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def retry_after_header(header: Column, cap: int | None = None) -> Column:
    """The number that a header begins with if it is over 0, else null; at most the cap."""
    n = F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"\A\s*\+?([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return F.when(n > 0, n if cap is None else F.least(n, F.lit(cap).cast("long")))


def passwords_match(first: Column, second: Column, least: int = 8) -> Column:
    """Both the same and at least so many characters."""
    return F.coalesce((first == second) & (F.char_length(first) >= least), F.lit(False))


def stored_email(email: Column, expires_at: Column, now: Column) -> Column:
    """A remembered address, empty once its time is over; without a time it stays. At the very end it still holds."""
    known = F.coalesce(email, F.lit(""))
    return F.when(expires_at.isNotNull() & (now > expires_at), "").otherwise(known)
