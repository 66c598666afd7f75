"""What a version-controlled folder says of itself: its head, its branch, its tracked files; read on the driver, a few small files each."""

from __future__ import annotations

import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def git_folder(root: str) -> Path | None:
    """The folder with the repository's data, also where ``.git`` is a file that names it."""
    at = Path(root) / ".git"
    if at.is_file():
        named = re.match(r"gitdir:\s*(.+)", at.read_text(errors="replace"))
        at = (Path(root) / named[1].strip()).resolve() if named else at
    return at if at.is_dir() else None


def git_meta(root: str) -> dict[str, str | None]:
    """``commit_sha, branch``: the commit of HEAD, through a loose or a packed reference; null where there is none, branch null where HEAD is detached."""
    folder = git_folder(root)
    head = (folder / "HEAD").read_text(errors="replace").strip() if folder and (folder / "HEAD").is_file() else ""
    if not head.startswith("ref:"):
        return {"commit_sha": head if re.fullmatch(r"[0-9a-f]{40,64}", head) else None, "branch": None}
    ref = head.removeprefix("ref:").strip()
    shared = folder / (folder / "commondir").read_text().strip() if (folder / "commondir").is_file() else folder
    sha = None
    for place in (folder, shared):
        if (place / ref).is_file():
            sha = (place / ref).read_text(errors="replace").strip()
            break
        packed = place / "packed-refs"
        if packed.is_file() and (found := re.search(rf"^([0-9a-f]{{40,64}}) {re.escape(ref)}$", packed.read_text(errors="replace"), re.M)):
            sha = found[1]
            break
    return {"commit_sha": sha, "branch": ref.removeprefix("refs/heads/")}


def tracked_paths(root: str) -> list[str]:
    """The paths in the index file (versions 2 and 3), in its order; none where there is no index or it is of another version."""
    folder = git_folder(root)
    data = (folder / "index").read_bytes() if folder and (folder / "index").is_file() else b""
    if data[:4] != b"DIRC" or struct.unpack(">I", data[4:8])[0] not in (2, 3):
        return []
    out, at = [], 12
    for _ in range(struct.unpack(">I", data[8:12])[0]):
        flags = struct.unpack(">H", data[at + 60 : at + 62])[0]
        begin = at + (64 if flags & 0x4000 else 62)
        end = data.index(b"\0", begin)
        out.append(data[begin:end].decode("utf-8", "replace"))
        at += (end - at) // 8 * 8 + 8
    return out


def tracked(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """The rows of ``files`` (``path``) that are tracked: a semi-join with the index's paths."""
    return files.join(spark.createDataFrame([(p,) for p in tracked_paths(root)], "path string"), "path", "left_semi")


def nested_roots(root: str) -> list[str]:
    """The folders below ``root`` that are repositories of their own, in order."""
    base = Path(root)
    return sorted(str(p.parent.relative_to(base)) for p in base.rglob(".git") if p.parent != base)


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(expression over repository paths, whether it excludes) of an ignore file in ``folder``, in order; the last that matches counts."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        only_folders, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body = line.strip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.*", i + 3
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
                out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        prefix = re.escape(folder.rstrip("/") + "/") if folder else ""
        rules.append((f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_folders else '(?:/.*)?'}$", not keep))
    return rules
