"""Staging of zipped sources on the driver, before Spark reads them."""

from __future__ import annotations

import zipfile
from pathlib import Path

#: Names of the archives that hold a file geodatabase (fixed pattern).
PATTERN = "NHDPLUS_H_*_HU4_GDB.zip"


def prepare(source: str) -> str:
    """Extract the archives of a folder below its `_extracted_gdb`, once each; the folder to read from.

    A source without archives is returned as it is. Archives that can't be read are left out, and if that is all of
    them, ValueError names them.
    """
    folder = Path(source)
    zips = sorted(folder.glob(PATTERN)) if folder.is_dir() else []
    if not zips:
        return source
    target, broken = folder / "_extracted_gdb", []
    for archive in zips:
        out = target / archive.stem
        if any(out.rglob("*.gdb")):
            continue
        try:
            with zipfile.ZipFile(archive) as z:
                inside = out.resolve()
                if any(not (out / name).resolve().is_relative_to(inside) for name in z.namelist()):
                    raise zipfile.BadZipFile("a member lies outside the archive's folder")
                out.mkdir(parents=True, exist_ok=True)
                z.extractall(out)
        except (zipfile.BadZipFile, OSError):
            broken.append(archive.name)
    if len(broken) == len(zips):
        raise ValueError(f"no archive could be read: {', '.join(broken)}")
    return str(target)
