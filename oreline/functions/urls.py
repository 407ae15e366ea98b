"""Repository URLs, share links and evidence links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CONTROLS = r"[\x00-\x1F\x7F-\x9F]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
LOST = "\ufffd"


def encode_component(text: Column) -> Column:
    """Percent encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def _decoded(text: Column) -> Column:
    """Percent decoding in UTF-8; null for broken escapes and for bytes that aren't UTF-8."""
    out = F.try_url_decode(text)
    odd = F.contains(out, F.lit(LOST)) & ~F.contains(text, F.lit(LOST)) & ~text.rlike("(?i)%EF%BF%BD")
    return F.when(~text.rlike(BAD_ESCAPE) & ~odd, out)


def decode_component(text: Column) -> Column:
    """Percent decoding; null if it fails. A plus stays a plus."""
    return _decoded(F.replace(text, F.lit("+"), F.lit("%2B")))


def is_reference_part(text: Column) -> Column:
    """Whether a decoded owner or name is one: not empty, no dot segment, separator, control character or white space."""
    return F.coalesce((text != "") & ~text.isin(".", "..") & ~text.rlike(r"[/\\]") & ~text.rlike(CONTROLS) & ~text.rlike(f"[{SPACES}]"), F.lit(False))


def is_reference(owner: Column, repo: Column) -> Column:
    return is_reference_part(owner) & is_reference_part(repo) & ~repo.rlike(r"(?i)\.git$")


def parse_repository(url: Column, host: str = "github.com") -> Column:
    """struct(owner, repo), or null.

    An HTTPS scheme or none, the default port, one '.git' and a trailing slash are
    taken; other schemes and hosts, credentials, queries and fragments aren't. Parts
    are percent-decoded, then checked.
    """
    name = host.replace(".", r"\.")
    trimmed = F.regexp_replace(url, f"^[{SPACES}]+|[{SPACES}]+$", "")
    pattern = rf"^(?i)(?:https://)?{name}(?::443)?/([^/?#\\]+)/([^/?#\\]+?)(?:\.git)?/?$"
    found = ~url.rlike(CONTROLS) & trimmed.rlike(pattern)
    owner, repo = (F.when(found, decode_component(F.regexp_extract(trimmed, pattern, k))) for k in (1, 2))
    return F.when(is_reference(owner, repo), F.struct(owner.alias("owner"), repo.alias("repo")))


def canonical(owner: Column, repo: Column, host: str = "github.com") -> Column:
    """The HTTPS URL of a repository; null for parts that no reference has."""
    return F.when(is_reference(owner, repo), F.concat(F.lit(f"https://{host}/"), encode_component(owner), F.lit("/"), encode_component(repo)))


def share_query(owner: Column, repo: Column) -> Column:
    """?repo=owner%2Frepo in form encoding; null for parts that no reference has."""
    return F.when(is_reference(owner, repo), F.concat(F.lit("?repo="), F.url_encode(F.concat(owner, F.lit("/"), repo))))


def parse_share(query: Column) -> Column:
    """struct(owner, repo) of exactly one repo=owner/name pair, else null."""
    pairs = F.split(F.regexp_replace(query, r"^\?", ""), "&")
    names = lambda p: F.coalesce(_decoded(F.substring_index(p, "=", 1)), F.lit("")) == "repo"
    own = F.filter(pairs, names)
    value = _decoded(F.regexp_replace(F.get(own, F.lit(0)), r"^[^=]*=?", ""))
    owner, repo = F.substring_index(value, "/", 1), F.substring_index(value, "/", -1)
    fine = ~query.rlike(CONTROLS) & decode_component(query).isNotNull() & (F.size(own) == 1) & value.rlike(r"^[^/]+/[^/]+$") & is_reference(owner, repo)
    return F.when(fine, F.struct(owner.alias("owner"), repo.alias("repo")))


def evidence_link(owner: Column, repo: Column, sha: Column, path: Column, start: Column, end: Column, host: str = "github.com") -> Column:
    """Link to the lines of a file at one commit."""
    coded = F.array_join(F.transform(F.split(path, "/"), encode_component), "/")
    lines = F.when(start.isNull(), "").when(end.isNull() | (end <= start), F.concat(F.lit("#L"), start)).otherwise(F.concat(F.lit("#L"), start, F.lit("-L"), end))
    return F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), repo, F.lit("/blob/"), sha, F.lit("/"), coded, lines)


def status_class(status: Column) -> Column:
    """What an HTTP status means for a request."""
    return (
        F.when(status.between(200, 299), "ok").when(status == 404, "not-found").when(status == 409, "empty").when(status.isin(403, 429), "rate-limit").otherwise("api")
    )


def may_retry(kind: Column, reset_at: Column, now: Column) -> Column:
    """Whether a failed run may be tried again: recoverable kinds, or a rate limit whose reset has passed."""
    return kind.isin("network", "api", "invalid-response", "worker") | ((kind == "rate-limit") & F.coalesce(reset_at <= now, F.lit(False)))


def repository_key(owner: Column, repo: Column) -> Column:
    """What repositories are the same by."""
    return F.lower(F.concat(owner, F.lit("/"), repo))
