"""Rebuilding texts from translated units, and writing them to a new place.

The rules for one file are plain functions over its text and units; apply_units() runs them per
file in one grouped pandas call (a file and its units are small, whatever the corpus). Line ends
of the file are kept. Units are placed at their exact ranges where these are known, so a text
that occurs twice is replaced where it was found.
"""

from __future__ import annotations

import os
import posixpath
import re
import stat
import time
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import file_system


def detect_ending(text: str) -> str:
    return "\r\n" if "\r\n" in text else "\n"


def to_lf(text: str) -> str:
    return text.replace("\r\n", "\n")


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final line end makes no empty line."""
    out = text.split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def lf_to_crlf_offset(text: str, offset: int) -> int:
    """Place in a text with CR LF of a place in the same text with LF."""
    at = 0
    for i, c in enumerate(text):
        if at >= offset:
            return i
        at += not (c == "\r" and text[i + 1 : i + 2] == "\n")
    return len(text)


_MARKS = ("///", "//!", "//", "/**", "/*", "*", "#")


def comment_prefix(line: str) -> str:
    body = line.lstrip()
    indent = line[: len(line) - len(body)]
    mark = next((m for m in _MARKS if body.startswith(m)), "")
    return f"{indent}{mark} " if mark else indent


class Loss(ValueError):
    """Raised in strict mode where a rule would drop lines of a translation."""


def replace_in_raw(raw: str, extracted: str, translated: str, strict: bool = False) -> str:
    """raw with the extracted text replaced: as a whole, else line by line. Comment marks stay. If
    the lines can't be found, raw stays as it is. Where the translation has another number of lines,
    all of it takes the place of the first extracted line and the other extracted lines go."""
    at = raw.find(extracted)
    if at >= 0:
        return raw[:at] + translated + raw[at + len(extracted) :]
    have, want, new = lines_of(raw), lines_of(extracted), lines_of(translated)
    if len(have) < len(want):
        return raw
    even, out, i = len(new) == len(want), [], 0
    block = len(have) > len(want)
    for line in have:
        at = line.find(want[i]) if i < len(want) else -1
        if at < 0:
            out.append(line)
            continue
        before, after = line[:at], line[at + len(want[i]) :]
        if even:
            out.append(before + new[i] + after)
        elif not block or i == 0:
            out.append(before + translated + after)
        else:
            if strict and not even and want[i].strip() and not new:
                raise Loss(want[i])
            out.append("")
        i += 1
    return "\n".join(out)


def _refilled_block(have: list[str], new: list[str], translated: str, strict: bool) -> str:
    body = translated.strip()
    if body.startswith("/*") and body.endswith("*/"):
        return translated
    todo, out = iter(new), []
    for line in have:
        t = line.strip()
        if t in ("/*", "/**", "*/"):
            out.append(line)
        elif t.endswith("*/"):
            inner = t[: t.find("*/")].strip()
            out.append(" */" if inner in ("", "*") else f" * {next(todo, '')} */")
        else:
            out.append(comment_prefix(line) + next(todo, ""))
    rest = list(todo)
    if rest and strict:
        raise Loss(rest[0])
    return "\n".join(out)


def _refilled_docstring(have: list[str], new: list[str]) -> str:
    quoted = lambda x: x.lstrip().startswith(('"""', "'''"))
    base = have[0][: len(have[0]) - len(have[0].lstrip())]
    inner = next((x[: len(x) - len(x.lstrip())] for x in have[1:] if x.strip() and not quoted(x)), base + "    ")
    todo, out = iter([x for x in new if x.strip()]), []
    for line in have:
        if quoted(line) or not line.strip():
            out.append(line)
        else:
            got = next(todo, None)
            out.append(line if got is None else inner + got)
    return "\n".join(out + [inner + x for x in todo])


def _refilled_lines(have: list[str], new: list[str], translated: str) -> str:
    if translated.lstrip().startswith(("//", "/*")):
        return translated
    if have and have[0].lstrip().startswith(('"""', "'''")):
        return _refilled_docstring(have, new)
    if len(have) == len(new):
        return "\n".join(comment_prefix(a) + b for a, b in zip(have, new))
    todo, out = iter(new), []
    for line in have:
        t = line.strip()
        mark = next((m for m in ("///", "//") if t.startswith(m)), "")
        holds = bool(t[len(mark) :].strip()) if mark else bool(t)
        out.append(comment_prefix(line) + (next(todo, "") if holds else ""))
    return "\n".join(out) + "\n".join(todo)


def format_translation(raw: str, translated: str, newline: bool = False, strict: bool = False) -> str:
    """A translation in the shape of the raw text: block comment, docstring or lines with their
    marks and indents; a line end at the end is kept. In a block comment surplus lines are dropped,
    or raise Loss if strict."""
    have, new = lines_of(raw), lines_of(translated)
    if have and have[0].strip().startswith("/*"):
        out = _refilled_block(have, new, translated, strict)
    else:
        out = _refilled_lines(have, new, translated)
    return out + "\n" if (raw.endswith("\n") or newline) and not out.endswith("\n") else out


def find_replacement(text: str, raw: str, start: int | None = None) -> tuple[int, int] | None:
    """Range of a raw text: at its place if it stands there, else its first occurrence; None if it
    doesn't occur. Both are given with LF."""
    if start is not None and text[start : start + len(raw)] == raw:
        return start, start + len(raw)
    at = text.find(raw)
    return (at, at + len(raw)) if at >= 0 else None


def splice(text: str, parts: Iterable[tuple[int, int, str]]) -> str:
    """text with ranges replaced, in the order of their places; of ranges that overlap the first stays."""
    out, at = [], 0
    for a, b, new in sorted(parts):
        if at <= a <= b <= len(text):
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def apply_lines(line: str, units: list[dict]) -> str:
    """One line with its units replaced, found by their raw text, else by their byte columns."""
    raw = line.encode()
    parts = []
    for u in units:
        m = u.get("raw_match")
        at = line.find(m) if m else -1
        if at >= 0:
            parts.append((at, at + len(m), replace_in_raw(m, u["content"], u["translated"])))
        elif u.get("column") and u.get("end_column"):
            a, b = (len(raw[: max(0, c - 1)].decode(errors="ignore")) for c in (u["column"], u["end_column"]))
            parts.append((a, b, u["translated"]))
    return splice(line, [(a, b, t) for a, b, t in parts if a < b])


def apply_translations(text: str, units: list[dict]) -> str:
    """A file's text with its translated units. units: content, translated, raw_match, and where
    known start (characters of the LF text), line, column, end_line, end_column. Units without a
    translation, or equal to it, leave the text as it is."""
    ending, t = detect_ending(text), to_lf(text)
    parts, single = [], {}
    for u in units:
        new, raw = u.get("translated"), u.get("raw_match")
        if new is None or new == u.get("content"):
            continue
        if raw and raw.strip() != new.strip():
            raw = to_lf(raw)
            where = find_replacement(t, raw, u.get("start"))
            if where:
                shaped = replace_in_raw(raw, u["content"], new) if u["content"] and "\n" not in raw else format_translation(raw, new) if "\n" in raw else new
                parts.append((*where, shaped))
                continue
        if u.get("line"):
            single.setdefault(int(u["line"]), []).append(u)
    if single:
        lines = t.split("\n")
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        for n, us in single.items():
            if n <= len(lines):
                new = apply_lines(lines[n - 1], us)
                if new != lines[n - 1]:
                    parts.append((starts[n - 1], starts[n - 1] + len(lines[n - 1]), new))
    out = splice(t, parts)
    return out.replace("\n", ending) if ending == "\r\n" else out


def apply_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path, before, after, changed, error) of files(path, text) and units(path, content, translated,
    raw_match, line, column). An error of one file never ends the job; its text stays."""
    u = units.groupBy("path").agg(F.collect_list(F.struct("content", "translated", "raw_match", "line", "column")).alias("units"))
    j = files.select("path", "text").join(u, "path", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text, us in zip(pdf["path"], pdf["text"], pdf["units"]):
                after, error = text, None
                try:
                    if text is not None and us is not None:
                        after = apply_translations(text, [dict(x) if isinstance(x, dict) else x.asDict() for x in us])
                except Exception as x:  # reported per file
                    error = str(x)[:500]
                rows.append((path, text, after, after != text, error))
            yield pd.DataFrame(rows, columns=["path", "before", "after", "changed", "error"])

    return j.mapInPandas(run, "path string, before string, after string, changed boolean, error string")


def preview(applied: DataFrame) -> DataFrame:
    """Changed files with the text before and after."""
    return applied.where("changed").select("path", "before", "after")


def backup_name(path: str, stamp: str) -> str:
    stem, ext = posixpath.splitext(posixpath.basename(path))
    return f"{stem}_{stamp}.bak{ext}"


def write_files(applied: DataFrame, root: str, backup_dir: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """Write the changed files below a root that all executors share, never in place: each to a temporary name of
    its own attempt, then moved, so a task that is run again or lost leaves whole files. root and backup_dir are
    paths or addresses of a file system. One result row per file: path, success, units_written, error. A file that
    already stands there is backed up first if a folder is given; on local disks its permissions are kept. Without a
    scheme the root must be a folder that is mounted on all machines."""

    def run(batches):
        from pyarrow import fs as pafs

        stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime())
        store, base = file_system(root)
        for pdf in batches:
            out = []
            for path, after, changed in zip(pdf["path"], pdf["after"], pdf["changed"]):
                ok, error = True, None
                try:
                    if changed:
                        goal = posixpath.normpath(posixpath.join(base, path.lstrip("/")))
                        if not goal.startswith(posixpath.normpath(base) + "/"):
                            raise ValueError("a path that leaves the root")
                        store.create_dir(posixpath.dirname(goal), recursive=True)
                        local, mode = isinstance(store, pafs.LocalFileSystem), None
                        if store.get_file_info(goal).type == pafs.FileType.File:
                            mode = stat.S_IMODE(os.stat(goal).st_mode) if local else None
                            if backup_dir:
                                kept, folder = file_system(backup_dir)
                                kept.create_dir(folder, recursive=True)
                                with store.open_input_stream(goal) as f, kept.open_output_stream(posixpath.join(folder, backup_name(path, stamp))) as g:
                                    g.write(f.read())
                        tmp = f"{goal}.{uuid.uuid4().hex}.tmp"
                        with store.open_output_stream(tmp) as f:
                            f.write(after.encode(encoding))
                        if mode is not None:
                            os.chmod(tmp, mode)
                        store.move(tmp, goal)
                except Exception as x:  # reported per file
                    ok, error = False, str(x)[:500]
                out.append((path, ok, int(bool(changed) and ok), error))
            yield pd.DataFrame(out, columns=["path", "success", "units_written", "error"])

    return applied.select("path", "after", "changed").mapInPandas(run, "path string, success boolean, units_written int, error string")


def write_table(applied: DataFrame, location: str, run_id: str) -> None:
    """The rebuilt files as one partition of a Parquet table: a version per run, never in place."""
    applied.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(location)
