"""Identity, path, URI and version functions (survey 1.4, N1-N5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def workflow_id(relative_path: Column) -> Column:
    """The POSIX path without one .xaml or .XAML at its end (other spellings stay)."""
    return F.regexp_replace(posix(relative_path), r"(\.xaml|\.XAML)$", "")


def composite_id(bay: Column, workflow: Column, content_hash: Column, digits: int = 16) -> Column:
    return F.concat_ws("#", bay, workflow, F.substring(content_hash, 1, digits))


def bay_id(name: Column, canonical_json: Column) -> Column:
    """Slug of at most 20 characters ("unnamed" if empty), a hyphen, ten digits of the metadata's hash."""
    short = F.substring(slug(name), 1, 20)
    return F.concat_ws("-", F.when(short == "", "unnamed").otherwise(short), F.substring(F.sha2(canonical_json, 256), 1, 10))


def activity_path(node_id: Column) -> Column:
    """Node id without the counters at the end of each of its parts."""
    return F.array_join(F.transform(F.split(node_id, "/"), lambda p: F.regexp_replace(p, r"(_[0-9]+)+$", "")), "/")


def resource_uri(project: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.lit("procgraph://lake/projects/"), slug(project), F.lit("/"), kind, F.lit("/"), F.replace(name, F.lit(" "), F.lit("%20")))


def uri_part(uri: Column, part: str) -> Column:
    """project, kind or name of a resource URI; "" for another string."""
    return F.regexp_extract(uri, "^procgraph://lake/projects/([^/]+)/([^/]+)/(.+)$", ("project", "kind", "name").index(part) + 1)


def file_size(size: Column) -> Column:
    """Bytes, or kilobytes and megabytes with one decimal."""
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / mb), F.lit(" MB")))


def human_size(size: Column) -> Column:
    """0B, or the size in the largest of B, KB, MB, GB and TB that it reaches, with at most two decimals and at least one."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.when(size == 0, "0B")
    for i, unit in enumerate(units):
        rounded = F.round(size.cast("double") / F.lit(float(1024**i)), 2)
        out = out.when(size < 1024 ** (i + 1), F.concat(shown(rounded), F.lit(f" {unit}"))) if unit != "TB" else out.otherwise(F.concat(shown(rounded), F.lit(" TB")))
    return out


def shown(number: Column) -> Column:
    """A number of at most two decimals as text, without zeros at its end but for the first decimal."""
    return F.regexp_replace(F.format_string("%.2f", number), r"(\.[0-9])0$", "$1")


VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def version_part(text: Column, part: str) -> Column:
    """major, minor, patch (long, null if invalid), pre or build (string, "" if absent)."""
    found = F.regexp_extract(text, VERSION, ("major", "minor", "patch", "pre", "build").index(part) + 1)
    return found if part in ("pre", "build") else F.when(text.rlike(VERSION), found.cast("bigint"))


def bump(text: Column, kind: str) -> Column:
    """The next version: major, minor and patch drop a pre-release (patch only completes it); pre counts on its last number."""
    major, minor, patch, pre = (version_part(text, p) for p in ("major", "minor", "patch", "pre"))
    join = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    if kind == "major":
        return join(major + 1, F.lit(0), F.lit(0))
    if kind == "minor":
        return join(major, minor + 1, F.lit(0))
    if kind == "patch":
        return F.when(pre == "", join(major, minor, patch + 1)).otherwise(join(major, minor, patch))
    number = F.regexp_extract(pre, r"([0-9]+)$", 1)
    base = F.regexp_replace(pre, r"[0-9]+$", "")
    counted = F.when(number == "", F.concat(pre, F.lit(".1"))).otherwise(F.concat(base, (number.cast("bigint") + 1).cast("string")))
    return F.when(pre == "", F.concat(join(major, minor, patch + 1), F.lit("-alpha.1"))).otherwise(F.concat(join(major, minor, patch), F.lit("-"), counted))


def next_version(text: Column, kind: str, tag: str = "rc") -> Column:
    """The version after `kind` of change; build metadata is dropped, an invalid version gives null.

    major, minor and patch of a pre-release only complete it; premajor, preminor and prepatch count on and add the tag;
    prerelease adds the tag to the next patch, or counts on in its own tag, or starts another one; release drops the pre-release.
    """
    major, minor, patch, pre = (version_part(text, p) for p in ("major", "minor", "patch", "pre"))
    dotted = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    core, zero, tagged = dotted(major, minor, patch), F.lit(0), lambda c: F.concat(c, F.lit(f"-{tag}"))
    counted = {"major": dotted(major + 1, zero, zero), "minor": dotted(major, minor + 1, zero), "patch": dotted(major, minor, patch + 1)}
    if kind == "release":
        out = core
    elif kind in counted:
        out = F.when(pre != "", core).otherwise(counted[kind])
    elif kind.removeprefix("pre") in counted:
        out = tagged(counted[kind.removeprefix("pre")])
    else:
        number = F.regexp_extract(pre, f"^{tag}\\.([0-9]+)$", 1)
        out = F.when(pre == "", tagged(counted["patch"])).when(pre == tag, F.concat(tagged(core), F.lit(".1")))
        out = out.when(number != "", F.concat(tagged(core), F.lit("."), (number.cast("bigint") + 1).cast("string"))).otherwise(tagged(core))
    return F.when(major.isNotNull(), out)


def camel(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1))))), "")
