"""Writing single notes, guarded: nothing outside the agent's folder without consent, nothing overwritten by chance."""

from __future__ import annotations

import datetime
import posixpath
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from noteweave.functions import front

#: Where agents may write freely, the agent's name, and where sessions, captures, concepts and tasks are kept.
OWN, AGENT = "Claude/", "claude"
SESSIONS, INBOX, CONCEPTS, INDEX, TASKS = "Claude/Sessions", "Claude/Inbox", "Claude/Concepts", "Claude/Index.md", "Claude/Tasks.md"
#: Fixed value: what a list of tasks begins with.
TASKS_SEED = "---\nagent: claude\ntags: [tasks]\n---\n\n# Tasks\n\n## Live view (all open tasks, vault-wide)\n\n```tasks\nnot done\ngroup by filename\n```\n\n## Open\n\n"
DUE = " \U0001f4c5 "
#: Times that a rename is tried.
ATTEMPTS = 5


def resolve(path: str) -> str:
    """A clean path within a vault; ValueError if it leaves it."""
    clean = posixpath.normpath(path.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean in ("..", ".") or ":" in clean.split("/")[0]:
        raise ValueError(f"outside the vault: {path}")
    return clean


def _file(spark: SparkSession, root: str, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_note(spark: SparkSession, root: str, path: str, text: str, overwrite: bool = False, confirm_outside: bool = False) -> str:
    """Write a note by way of a temporary file and a rename; line ends become LF."""
    path = resolve(path)
    if not path.startswith(OWN) and not confirm_outside:
        raise PermissionError(f"outside {OWN} without consent: {path}")
    jvm, target, fs = _file(spark, root, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.replace("\r\n", "\n").replace("\r", "\n").encode()))
    finally:
        out.close()
    _replace(spark, part, target)
    return path


def _replace(spark: SparkSession, part, target, attempts: int = ATTEMPTS) -> None:
    """Rename over what is there, in one step of the file system, which may be busy for a moment."""
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    for n in range(attempts):
        try:
            context.rename(part, target, over)
            return
        except Py4JJavaError:
            if n + 1 == attempts:
                raise
            time.sleep(0.1 * 2**n)


def append_note(spark: SparkSession, root: str, path: str, text: str, confirm_outside: bool = False) -> str:
    """Add to a note, or begin it."""
    jvm, target, fs = _file(spark, root, resolve(path))
    old = ""
    if fs.exists(target):
        stream = fs.open(target)
        try:
            old = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return write_note(spark, root, path, old + text, overwrite=True, confirm_outside=confirm_outside)


def move_note(spark: SparkSession, root: str, source: str, target: str) -> None:
    _, a, fs = _file(spark, root, resolve(source))
    _, b, _ = _file(spark, root, resolve(target))
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source}")


def exists(spark: SparkSession, root: str, path: str) -> bool:
    _, target, fs = _file(spark, root, resolve(path))
    return bool(fs.exists(target))


def _names(spark: SparkSession, root: str, folder: str) -> list[str]:
    """File names directly in a folder."""
    _, target, fs = _file(spark, root, resolve(folder))
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def clean_name(title: str) -> str:
    """A title as a file name."""
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\[\]#^]', "", title)).strip() or "untitled"


def _front(when: datetime.datetime, project: str = "", tags: list[str] | None = None) -> str:
    return front.write({"created": f"{when:%Y-%m-%d %H:%M}", "agent": AGENT, "project": project, "tags": tags or []})


def log_session(spark: SparkSession, root: str, title: str, content: str, project: str, tags: list[str], when: datetime.datetime) -> str:
    """A note on a session under a name of its own, and a line in the index; its path."""
    base, taken, n = f"{when:%Y-%m-%d} {clean_name(title)}", {x.lower() for x in _names(spark, root, SESSIONS)}, 1
    stem = base
    while f"{stem}.md".lower() in taken:
        n += 1
        stem = f"{base} {n}"
    path = write_note(spark, root, f"{SESSIONS}/{stem}.md", _front(when, project, tags) + content + "\n")
    append_note(spark, root, INDEX, f"- [[{stem}]] — {project}: {title}\n")
    return path


def capture(spark: SparkSession, root: str, content: str, when: datetime.datetime) -> str:
    """A line in the day's inbox."""
    return append_note(spark, root, f"{INBOX}/{when:%Y-%m-%d}.md", f"- {when:%H:%M} {content}\n")


def upsert_concept(spark: SparkSession, root: str, name: str, content: str, when: datetime.datetime) -> str:
    """A concept's note, begun, or with a dated section more; names match whatever their case."""
    wanted = f"{clean_name(name)}.md"
    found = next((x for x in sorted(_names(spark, root, CONCEPTS)) if x.casefold() == wanted.casefold()), None)
    if found is None:
        return write_note(spark, root, f"{CONCEPTS}/{wanted}", _front(when, tags=["concept"]) + f"# {name}\n\n{content}\n")
    return append_note(spark, root, f"{CONCEPTS}/{found}", f"\n## Update {when:%Y-%m-%d}\n\n{content}\n")


def add_task(spark: SparkSession, root: str, content: str, due: str | None = None) -> str:
    """An open task at the end of the list, which is begun where there is none; ``due`` is a day, YYYY-MM-DD."""
    if due is not None:
        datetime.datetime.strptime(due, "%Y-%m-%d")
    if not exists(spark, root, TASKS):
        write_note(spark, root, TASKS, TASKS_SEED)
    return append_note(spark, root, TASKS, f"- [ ] {' '.join(content.split())}" + (f"{DUE}{due}" if due else "") + "\n")
