"""Column builders for note text: tokens, lines, front matter, links, tasks, names and URLs. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions import front

#: Line breaks, URL parameters that only track, and the line formats of notes: check boxes, link targets,
#: mentions, relations, list items by project, and characters that file names lack.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
TRACKING = "^(utm_.*|ref|src|gh_src|lever-origin)$"
TASK = r"^\s*[-*] \[([ xX])\] (.+)$"
LINK = r"\[\[([^\]|#]+)"
MENTION = r"^- \[\[([^\]|]+)\|[^\]]+\]\](?:\s+[—-]\s+(.*))?$"
RELATION = r"(?U)^- (\w+) \[\[([^\]|]+)\|[^\]]+\]\]$"
NOT_IN_NAMES, NOT_IN_FILES = r'[\\/:*?"<>|\[\]#^`]', r'[\\/:*?"<>|\x00-\x1f]'


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text by any line break; no empty last line."""
    parts = F.split(text, LINE_BREAK)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def path_key(path: Column) -> Column:
    """Sorts paths by component rather than by character."""
    return F.split(path, "/")


def stem(path: Column) -> Column:
    """The file name of a path, without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def suffix_stem(path: Column) -> Column:
    """The last component without its last dot suffix (for paths kept without ``.md``)."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def top_folder(path: Column) -> Column:
    return F.get(F.split(path, "/"), 0)


def _fence(text: Column) -> Column:
    return F.when(text.startswith("---"), F.locate("\n---", text, 4)).otherwise(F.lit(0))


def front_matter(text: Column) -> Column:
    """The block between the fences at the text's start; empty without one."""
    at = _fence(text)
    return F.when(at > 0, F.substr(text, F.lit(4), at - 4)).otherwise(F.lit(""))


def body(text: Column) -> Column:
    """The text behind the closing fence mark, or all of it."""
    at = _fence(text)
    return F.when(at > 0, F.substr(text, at + 4)).otherwise(text)


def front_value(text: Column, key: str) -> Column:
    """A scalar of the front matter as text; empty where it is absent or null."""
    return F.coalesce(front.value(front.meta(text), key), F.lit(""))


def front_list(text: Column, key: str) -> Column:
    """A list of the front matter, or a scalar as a list of one; empty without it."""
    return front.values(front.meta(text), key)


def excerpt(text: Column, path: Column, query: str, cut: int = 120) -> Column:
    """``(title match)``, or the body's first line that holds the query, or its first line, cut; or nothing."""
    wanted = F.lit(query.lower())
    rows = F.transform(lines(body(text)), lambda x: F.trim(x))
    hit = F.get(F.filter(rows, lambda x: F.contains(F.lower(x), wanted)), 0)
    first = F.substring(F.get(F.filter(rows, lambda x: x != ""), 0), 1, cut)
    return F.when(F.contains(F.lower(stem(path)), wanted), F.lit("(title match)")).otherwise(F.coalesce(hit, first, F.lit("")))


def body_excerpt(text: Column, cut: int = 400) -> Column:
    return F.substring(F.trim(F.regexp_replace(body(text), r"\s+", " ")), 1, cut)


def wikilinks(text: Column) -> Column:
    """Folded stems of the link targets of a text."""
    targets = F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    return F.transform(targets, lambda t: F.lower(F.trim(F.element_at(F.split(t, "/"), -1))))


def tasks(text: Column) -> Column:
    """Check-box lines as structs of done and task, in order."""
    found = F.filter(lines(text), lambda x: x.rlike(TASK))
    return F.transform(found, lambda x: F.struct((F.lower(F.regexp_extract(x, TASK, 1)) == "x").alias("done"), F.trim(F.regexp_extract(x, TASK, 2)).alias("task")))


def heading(text: Column, path: Column) -> Column:
    """The first top heading, else the stem."""
    found = F.regexp_extract(text, "(?m)^# (.+)$", 1)
    return F.when(found != "", found).otherwise(stem(path))


def section_lines(text: Column, header: str) -> Column:
    """The list lines of a section, from the header's first place to the next one of its level."""
    at = F.locate(header, text)
    rest = F.substring_index(F.substr(text, at + len(header)), "\n## ", 1)
    return F.when(at > 0, F.filter(lines(rest), lambda x: x.startswith("- "))).otherwise(F.array().cast("array<string>"))


def mention_line(line: Column) -> Column:
    """(target, evidence) of a line ``- [[target|name]] - evidence``."""
    return F.struct(F.regexp_extract(line, MENTION, 1).alias("target"), F.regexp_extract(line, MENTION, 2).alias("evidence"))


def relation_line(line: Column) -> Column:
    """(rel, target) of a line ``- rel [[target|name]]``."""
    return F.struct(F.regexp_extract(line, RELATION, 1).alias("rel"), F.regexp_extract(line, RELATION, 2).alias("target"))


def _link_to(path: str) -> str:
    return r"\[\[" + re.escape(path) + r"(?=[\]|#])"


def relink(text: Column, old: str, new: str) -> Column:
    """Links to a path rewritten to another."""
    return F.regexp_replace(text, _link_to(old), ("[[" + new).replace("\\", "\\\\").replace("$", "\\$"))


def link_count(text: Column, path: str) -> Column:
    """Links that ``relink`` would rewrite."""
    return F.regexp_count(text, F.lit(_link_to(path)))


def norm(text: Column) -> Column:
    """White space collapsed and trimmed, folded."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def safe_name(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, NOT_IN_NAMES, ""), r"\s+", " "))
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def file_name(text: Column, cut: int = 120) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, NOT_IN_FILES, "-"), r"\s+", " "))
    return F.rtrim(F.substring(clean, 1, cut))


def render(template: str, columns: list[str]) -> Column:
    """A template like ``{name} - {place}`` filled with columns (null as nothing), as a file name."""
    parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in columns else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return file_name(F.concat(*parts) if parts else F.lit(""))


def normalize_link(url: Column) -> Column:
    """A URL with scheme and host in lower case, no trailing slash, fragment or tracking parameters, parameters sorted."""
    clean = F.trim(url)
    no_fragment = F.substring_index(clean, "#", 1)
    base = F.substring_index(no_fragment, "?", 1)
    query = F.when(F.locate("?", no_fragment) > 0, F.substr(no_fragment, F.locate("?", no_fragment) + 1)).otherwise(F.lit(""))
    head = F.lower(F.regexp_extract(base, r"^([^:/]+://[^/]*)", 1))
    path = F.rtrim(F.regexp_replace(base, r"^[^:/]+://[^/]*", ""), F.lit("/"))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING))
    params = F.array_join(F.array_sort(kept), "&")
    return F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), F.when(params == "", F.lit("")).otherwise(F.concat(F.lit("?"), params)))


def entity_summary(text: Column) -> Column:
    """The body up to the mentions without headings of the first level: the lines of a summary."""
    kept = F.filter(lines(F.substring_index(body(text), "## Mentions", 1)), lambda x: ~x.startswith("# "))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""))


def identity(name: Column, aliases: Column, summary: Column) -> Column:
    """The text that stands for an entity when it is embedded: name, aliases and summary, a line each."""
    return F.regexp_replace(F.concat_ws("\n", name, F.array_join(aliases, ","), summary), r"^\s+|\s+$", "")


def listing(kind: Column, name: Column, aliases: Column) -> Column:
    """An entity's line in a list for an adjudicator."""
    return F.concat_ws(" | ", kind, name, F.when(F.size(aliases) > 0, F.array_join(aliases, ", ")).otherwise("-"))


def project_of(path: str) -> str:
    """The project that a working folder stands for: its last component, by either separator."""
    return re.split(r"[\\/]", path.rstrip("\\/"))[-1]


def state_key(path: Column) -> Column:
    """The name of a vault's state folder."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 12)


def last_error(text: Column, cut: int = 300) -> Column:
    """The last line that names an error, cut; else the text's end."""
    hit = F.filter(lines(text), lambda x: x.rlike(r"(?i)\b(ERROR|FATAL)\b"))
    return F.when(F.size(hit) > 0, F.substring(F.element_at(hit, -1), 1, cut)).otherwise(F.substr(text, F.greatest(F.length(text) - cut + 1, F.lit(1))))


def json_safe(value: Column) -> Column:
    """Any nested value as JSON: days and times as ISO text, nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
