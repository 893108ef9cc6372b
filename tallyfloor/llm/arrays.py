"""Arrays in the shared folder that Python workers map into memory, so that workers of one machine share its file cache."""

from __future__ import annotations

import io
import uuid

import numpy as np


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write_array(folder: str, values: np.ndarray) -> str:
    """Writes an array under a new name, which it returns; the name of a lost attempt is never used."""
    system, root = _filesystem(folder)
    held = io.BytesIO()
    np.save(held, values, allow_pickle=False)
    name = f"{uuid.uuid4().hex}.npy"
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(held.getbuffer())
    return name


def open_array(folder: str, name: str) -> np.ndarray:
    """The array: mapped where the folder is a local or mounted path, else read."""
    system, root = _filesystem(folder)
    if system.type_name == "local":
        return np.load(f"{root}/{name}", mmap_mode="r", allow_pickle=False)
    with system.open_input_file(f"{root}/{name}") as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)
