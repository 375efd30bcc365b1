"""The binary trace directory: files, structures, grammars.

All numbers are little-endian. ``VERSION`` holds the format version. A metadata file ``*.mt`` (other than ``ug.mt``) holds a
fixed head and one function name per line. ``R.cst`` holds the call signatures of rank R, ``R.cfg`` its grammar, ``R.ts``
its times as pairs of distances from the previous start. With merging across ranks there is one ``0.cst``, a grammar for
each distinct one, and ``ug.mt`` says which rank has which.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs as afs

#: Fixed values of the format: supported version, head of the metadata file, heads of entries.
VERSION = (2, 5)
HEAD = struct.Struct("<i4xddiii4x")
SIGNATURE_HEAD = struct.Struct("<iiiI")
KEY_HEAD = struct.Struct("<qBBBi")
ROOT_RULE = -1
USER_FUNCTION_ID = 255


class Folder:
    """Files of one folder on any file system pyarrow knows."""

    def __init__(self, path: str):
        self.fs, self.path = afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{name}") as f:
            f.write(data)

    def create(self, name: str):
        """A stream into a new file."""
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type == afs.FileType.File

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def state(self, name: str) -> tuple:
        """What changes when the file is written again."""
        i = self.fs.get_file_info(f"{self.path}/{name}")
        return name, i.size, i.mtime_ns

    def sizes(self) -> dict[str, int]:
        return {i.base_name: i.size for i in self.fs.get_file_info(afs.FileSelector(self.path)) if i.type == afs.FileType.File}

    def names(self) -> list[str]:
        return [i.base_name for i in self.fs.get_file_info(afs.FileSelector(self.path)) if i.type == afs.FileType.File]

    def move(self, old: str, new: str) -> None:
        self.fs.move(f"{self.path}/{old}", f"{self.path}/{new}")

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")


@dataclass
class Metadata:
    total_ranks: int
    start_ts: float
    time_resolution: float
    ts_buffer_elements: int
    ts_compression_algo: int
    interprocess_compression: int
    functions: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        first = lambda part: next((i for i, n in enumerate(self.functions) if part in n), len(self.functions))
        self.first_mpi, self.first_hdf5 = first("MPI"), first("H5")

    def category(self, func_id: int) -> int:
        if func_id == USER_FUNCTION_ID:
            return 4
        if func_id < self.first_mpi:
            return 0
        if func_id < self.first_hdf5:
            return 1 if self.functions[func_id].startswith("MPI_File") else 2
        return 3

    def row(self) -> tuple:
        return (self.total_ranks, self.start_ts, self.time_resolution, self.ts_buffer_elements, self.ts_compression_algo, self.interprocess_compression)


def check_version(folder: Folder) -> None:
    text = folder.read("VERSION").decode().strip("\0 \n")
    if tuple(int(x) for x in text.split(".")[:2]) != VERSION:
        raise ValueError(f"format {text} is not {VERSION[0]}.{VERSION[1]}")


def read_metadata(folder: Folder) -> Metadata:
    check_version(folder)
    name = next(n for n in sorted(folder.names()) if n.endswith(".mt") and n != "ug.mt")
    data = folder.read(name)
    names = data[HEAD.size :].decode().split("\n")
    strip = lambda n: n[1:] if n.startswith("PMPI_") else n
    return Metadata(*HEAD.unpack_from(data), [strip(n) for n in names if n])


def write_metadata(folder: Folder, meta: Metadata, name: str = "trace.mt") -> None:
    folder.write("VERSION", f"{VERSION[0]}.{VERSION[1]}.0".encode())
    folder.write(name, HEAD.pack(*meta.row()) + "".join(n + "\n" for n in meta.functions).encode())


def pack_key(tid: int, func_id: int, level: int, args: list[str | None]) -> bytes:
    """Blanks inside arguments become underscores, a missing argument three question marks."""
    text = "".join(("???" if a is None else a.replace(" ", "_")) + " " for a in args).encode()
    return KEY_HEAD.pack(tid, func_id, level, len(args), len(text)) + text


def unpack_key(key: bytes) -> tuple[int, int, int, list[str]]:
    tid, func_id, level, n, length = KEY_HEAD.unpack_from(key)
    text = key[KEY_HEAD.size : KEY_HEAD.size + length].decode(errors="replace")
    args = text.split(" ")[:n] if n else []
    if len(args) != n:
        raise ValueError("a signature has fewer arguments than it says")
    return tid, func_id, level, args


def read_signatures(folder: Folder, name: str) -> list[tuple]:
    """(terminal_id, rank, count, tid, func_id, level, args), by terminal id."""
    data, at, out = folder.read(name), 4, []
    for _ in range(struct.unpack_from("<i", data)[0]):
        terminal, rank, length, count = SIGNATURE_HEAD.unpack_from(data, at)
        at += SIGNATURE_HEAD.size
        out.append((terminal, rank, count, *unpack_key(data[at : at + length])))
        at += length
    return sorted(out, key=lambda s: s[0])


def pack_signature(terminal_id: int, rank: int, count: int, key: bytes) -> bytes:
    return SIGNATURE_HEAD.pack(terminal_id, rank, len(key), count) + key


def pack_signatures(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """rows: (terminal_id, rank, count, key)."""
    return struct.pack("<i", len(rows)) + b"".join(pack_signature(*r) for r in rows)


def read_grammar(folder: Folder, name: str) -> dict[int, np.ndarray]:
    """rule id -> its body as rows (value, exponent)."""
    data = np.frombuffer(folder.read(name), "<i4")
    at, out = 1, {}
    for _ in range(int(data[0])):
        rule, n = int(data[at]), int(data[at + 1])
        out[rule] = data[at + 2 : at + 2 + 2 * n].reshape(n, 2)
        at += 2 + 2 * n
    return out


def pack_grammar(rules: dict[int, list[tuple[int, int]]]) -> bytes:
    flat = [len(rules)]
    for rule, body in rules.items():
        flat += [rule, len(body), *(x for pair in body for x in pair)]
    return np.array(flat, "<i4").tobytes()


def expand(rules: dict[int, np.ndarray], chunk: int = 1 << 16, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The terminals a grammar stands for from number ``start`` to ``stop``, in order, in arrays of about ``chunk``.

    Short rules are expanded once and repeated; what comes before ``start`` is passed over by the lengths of rules.
    """
    short: dict[int, np.ndarray] = {}
    lengths: dict[int, int] = {}

    def length(rule: int) -> int:
        if rule not in lengths:
            lengths[rule] = sum(int(e) * (1 if v >= 0 else length(int(v))) for v, e in rules[rule])
        return lengths[rule]

    def whole(rule: int) -> np.ndarray:
        if rule not in short:
            parts = [np.repeat(np.int32(v), e) if v >= 0 else np.tile(whole(int(v)), e) for v, e in rules[rule].tolist()]
            short[rule] = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return short[rule]

    def walk(rule: int, skip: int) -> Iterator[np.ndarray]:
        if length(rule) <= chunk:
            yield whole(rule)[skip:]
            return
        for v, e in rules[rule].tolist():
            unit = 1 if v >= 0 else length(v)
            passed = min(e, skip // unit)
            e, skip = e - passed, skip - passed * unit
            if v >= 0:
                while e > 0:
                    yield np.full(min(e, chunk), v, np.int32)
                    e -= chunk
            else:
                for _ in range(e):
                    yield from walk(v, skip)
                    skip = 0

    left = length(ROOT_RULE) - start if stop is None else stop - start
    held, n = [], 0
    for part in walk(ROOT_RULE, start) if left > 0 else ():
        held.append(part[:left])
        n += len(held[-1])
        left -= len(held[-1])
        if n >= chunk or left <= 0:
            yield np.concatenate(held)
            held, n = [], 0
        if left <= 0:
            return
    if n:
        yield np.concatenate(held)


def expanded_length(rules: dict[int, np.ndarray]) -> int:
    """How many terminals a grammar stands for, without expanding it."""
    known: dict[int, int] = {}

    def length(rule: int) -> int:
        if rule not in known:
            known[rule] = sum(int(e) * (1 if v >= 0 else length(int(v))) for v, e in rules[rule])
        return known[rule]

    return length(ROOT_RULE)


class Sequence:
    """A sequence that turns into a grammar while symbols are appended (Sequitur, with exponents for runs).

    Two neighbouring symbols, with their exponents, stand in the grammar only once: where they come again, both places
    become a rule. A rule that is used once, without an exponent, is put back in its place. Every append takes constant
    time on average, so a sequence is read once, whatever its length.
    """

    def __init__(self) -> None:
        self.value: list[int] = []
        self.times: list[int] = []
        self.after: list[int] = []
        self.before: list[int] = []
        self.live: list[bool] = []
        self.owner: dict[int, int] = {}  # guard -> rule
        self.guard: dict[int, int] = {}  # rule -> guard, the node before its first and behind its last symbol
        self.uses: dict[int, set[int]] = {}  # rule -> nodes that use it
        self.places: dict[tuple, int] = {}  # two symbols -> the node of the first, where they stand
        self.made = ROOT_RULE
        self.root = self._rule()

    def _node(self, value: int, times: int) -> int:
        k = len(self.value)
        self.value.append(value)
        self.times.append(times)
        self.after.append(k)
        self.before.append(k)
        self.live.append(True)
        if value < 0 and k not in self.owner and value in self.uses:
            self.uses[value].add(k)
        return k

    def _rule(self) -> int:
        rule, self.made = self.made, self.made - 1
        g = self._node(0, 0)
        self.owner[g], self.guard[rule], self.uses[rule] = rule, g, set()
        return rule

    def _link(self, a: int, b: int) -> None:
        self.after[a], self.before[b] = b, a

    def _pair(self, a: int) -> tuple | None:
        b = self.after[a]
        if a in self.owner or b in self.owner:
            return None
        return self.value[a], self.times[a], self.value[b], self.times[b]

    def _forget(self, a: int) -> None:
        """The pair that begins at a no longer stands there."""
        key = self._pair(a)
        if key is not None and self.places.get(key) == a:
            del self.places[key]

    def _drop(self, k: int) -> None:
        self.live[k] = False
        if self.value[k] in self.uses and k not in self.owner:
            self.uses[self.value[k]].discard(k)

    def append(self, value: int) -> None:
        g = self.guard[self.root]
        last = self.before[g]
        if last != g and self.value[last] == value:
            self._forget(self.before[last])
            self.times[last] += 1
            self._settle([self.before[last]])
            return
        k = self._node(value, 1)
        self._link(last, k)
        self._link(k, g)
        self._settle([last])

    def _replace(self, a: int, rule: int, pending: list[int]) -> None:
        """The pair at a becomes the rule; equal neighbours become one symbol."""
        b = self.after[a]
        left, right = self.before[a], self.after[b]
        for x in (left, a, b):
            self._forget(x)
        self._drop(a)
        self._drop(b)
        times = 1
        if left not in self.owner and self.value[left] == rule:
            times += self.times[left]
            self._forget(self.before[left])
            self._drop(left)
            left = self.before[left]
        if right not in self.owner and self.value[right] == rule:
            times += self.times[right]
            self._forget(right)
            self._drop(right)
            right = self.after[right]
        k = self._node(rule, times)
        self._link(left, k)
        self._link(k, right)
        pending += [k, left]

    def _settle(self, pending: list[int]) -> None:
        while pending:
            a = pending.pop()
            if not self.live[a]:
                continue
            key = self._pair(a)
            if key is None:
                continue
            other = self.places.get(key)
            if other is None:
                self.places[key] = a
                continue
            if other == a or self.after[other] == a or self.after[a] == other:
                continue
            end = self.after[self.after[other]]
            if self.before[other] in self.owner and end in self.owner and self.owner[end] != self.root:
                rule = self.owner[end]  # the pair is a whole rule already
                self._replace(a, rule, pending)
            else:
                rule = self._rule()
                g = self.guard[rule]
                x, y = self._node(*key[:2]), self._node(*key[2:])
                for p, q in ((g, x), (x, y), (y, g)):
                    self._link(p, q)
                self._replace(other, rule, pending)
                if self.live[a] and self._pair(a) == key:
                    self._replace(a, rule, pending)
                self.places[key] = x
            self._put_back(rule, pending)

    def _put_back(self, rule: int, pending: list[int]) -> None:
        """Rules that only this one uses, and once, stand in it themselves."""
        g = self.guard[rule]
        for k in (self.after[g], self.before[g]):
            inner = self.value[k]
            if k == g or not self.live[k] or inner not in self.uses or len(self.uses[inner]) != 1 or self.times[k] != 1:
                continue
            left, right, ig = self.before[k], self.after[k], self.guard[inner]
            self._forget(left)
            self._forget(k)
            self._drop(k)
            first, last = self.after[ig], self.before[ig]
            self._link(left, first)
            self._link(last, right)
            self.live[ig] = False
            del self.owner[ig], self.guard[inner], self.uses[inner]
            pending += [last, left]

    def rules(self) -> dict[int, list[tuple[int, int]]]:
        """Bodies as (symbol, exponent); rules are numbered in the order in which they are met."""
        number, order = {self.root: ROOT_RULE}, [self.root]
        bodies: dict[int, list[tuple[int, int]]] = {}
        for rule in order:
            body, k = [], self.after[self.guard[rule]]
            while k not in self.owner:
                v = self.value[k]
                if v in self.uses:
                    if v not in number:
                        number[v] = ROOT_RULE - len(number)
                        order.append(v)
                    v = number[v]
                body.append((v, self.times[k]))
                k = self.after[k]
            bodies[number[rule]] = body
        return bodies


def compress(ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """A grammar for ids (non-negative), in one pass."""
    s = Sequence()
    for i in ids.tolist():
        s.append(i)
    return s.rules()
