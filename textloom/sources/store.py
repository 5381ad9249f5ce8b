"""The caches as tasks see them: rows looked up and added with Arrow.

A file's rows are sorted by content hash in small row groups, and the log knows each file's range, so
a lookup opens the files and reads the row groups that its hashes can be in, one after another. Hashes are random, so a batch of
texts in no order meets all row groups; texts that come sorted by hash meet each about once. A task adds what it
computed as one file (or one for every ``FLUSH`` rows or ``FLUSH_BYTES``), and leaves out what others added meanwhile.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from .log import ArrowFiles, File, Log

#: Rows of a row group, and rows that a task holds before it adds them; the same in bytes, about; bytes of texts that are looked up at once.
GROUP, FLUSH = 1024, 50_000
GROUP_BYTES, FLUSH_BYTES, ASKED = 4 << 20, 32 << 20, 4 << 20
HASH = "content_hash"


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Store:
    """Rows of one cache: ``keys`` are the columns that, with content_hash, say what a row is for."""

    def __init__(self, path: str, schema: pa.Schema, keys: dict[str, str]):
        self.schema, self.keys = schema, keys
        self.log = Log(ArrowFiles(path))
        self.log.refresh()
        self.opened: dict[str, tuple[pq.ParquetFile, list[tuple[str, str]]]] = {}
        self.groups_read = 0

    def _open(self, file: File) -> tuple[pq.ParquetFile, list[tuple[str, str]]]:
        """A file and the range of hashes of each of its row groups; footers are read once."""
        if file.name not in self.opened:
            at = self.log.files
            found = pq.ParquetFile(at.fs.open_input_file(f"{at.root}/{file.name}"))
            column = found.schema_arrow.names.index(HASH)
            leaf = next(k for k in range(found.metadata.num_columns) if found.schema.column(k).path == found.schema_arrow.names[column])
            ranges = [found.metadata.row_group(g).column(leaf).statistics for g in range(found.num_row_groups)]
            self.opened[file.name] = found, [(s.min, s.max) if s is not None and s.has_min_max else ("", "g") for s in ranges]
        return self.opened[file.name]

    def fetch(self, hashes: Sequence[str], files: Sequence[File] | None = None) -> pa.Table:
        """The rows of these hashes in ``files`` (all, if None)."""
        ordered, parts = sorted(set(hashes)), []
        wanted = pa.array(ordered, pa.string())
        for file in self.log.live.values() if files is None else files:
            if not file.may_have(ordered):
                continue
            found, ranges = self._open(file)
            groups = [g for g, (a, b) in enumerate(ranges) if File("", a, b, 0).may_have(ordered)]
            self.groups_read += len(groups)
            for group in groups:  # what isn't asked for is let go before the next one is read
                rows = found.read_row_group(group, columns=self.schema.names).select(self.schema.names).cast(self.schema)
                mask = pc.is_in(rows[HASH], wanted)
                for name, value in self.keys.items():
                    mask = pc.and_(mask, pc.equal(rows[name], value))
                rows = rows.filter(mask)
                if rows.num_rows:
                    parts.append(rows)
        return pa.concat_tables(parts) if parts else self.schema.empty_table()

    def _write(self, rows: pa.Table, out: pa.NativeFile) -> None:
        """Small row groups; lists of numbers as differences, which offsets need few bits for."""
        leaves = {f.name: f"{f.name}.list.element" if pa.types.is_list(f.type) else f.name for f in self.schema}
        numbers = [leaves[f.name] for f in self.schema if pa.types.is_list(f.type) and pa.types.is_integer(f.type.value_type)]
        size = min(GROUP, max(1, GROUP_BYTES * rows.num_rows // max(rows.nbytes, 1)))
        pq.write_table(rows, out, row_group_size=size, compression="zstd", use_dictionary=[x for x in leaves.values() if x not in numbers], column_encoding=dict.fromkeys(numbers, "DELTA_BINARY_PACKED") or None)

    def add(self, rows: pa.Table) -> None:
        """Commit rows as one file, without those that another writer has committed since this store was read."""
        rows, file = rows.cast(self.schema).sort_by(HASH), None
        while rows.num_rows:
            if file is None:
                hashes = rows[HASH]
                file = File(f"data/{uuid.uuid4().hex}.parquet", hashes[0].as_py(), hashes[-1].as_py(), rows.num_rows)
                at = self.log.files
                at.fs.create_dir(f"{at.root}/data", recursive=True)
                with at.fs.open_output_stream(f"{at.root}/{file.name}") as out:
                    self._write(rows, out)
            if self.log.commit([file]):
                return
            others = self.fetch(rows[HASH].to_pylist(), self.log.refresh())[HASH]
            if len(others):
                self.log.files.delete(file.name)
                rows, file = rows.filter(pc.invert(pc.is_in(rows[HASH], others.combine_chunks()))), None


class Lookup:
    """A task's way through a store: ``rows`` of texts, from the store or computed once for each text that it lacks.

    ``compute`` makes the columns of texts besides the keys; ``valid`` masks rows of the store
    that count. What was computed is added when ``close`` is called, or every FLUSH rows or FLUSH_BYTES.
    """

    def __init__(self, store: Store, compute: Callable[[list[str]], pa.Table], valid: Callable[[pa.Table], pa.Array] | None = None):
        self.store, self.compute, self.valid = store, compute, valid
        self.fresh = store.schema.empty_table()

    def rows(self, texts: Sequence[str | None]) -> pa.Table:
        """A row for each text, in order; nulls for null."""
        hashes = [None if t is None else hash_text(t) for t in texts]
        asked = {h: t for h, t in zip(hashes, texts, strict=True) if h is not None}
        own = self.fresh.filter(pc.is_in(self.fresh[HASH], pa.array(list(asked), pa.string())))
        have = set(own[HASH].to_pylist())
        found = self.store.fetch([h for h in asked if h not in have])
        if self.valid is not None:
            found = found.filter(self.valid(found))
        have.update(found[HASH].to_pylist())
        todo = [h for h in asked if h not in have]
        if todo:
            made = self.compute([asked[h] for h in todo])
            if made.num_rows != len(todo):
                raise ValueError(f"{made.num_rows} results for {len(todo)} texts")
            for name, value in [*self.store.keys.items(), (HASH, None)]:
                made = made.append_column(name, pa.array(todo if value is None else [value] * len(todo), pa.string()))
            made = made.select(self.store.schema.names).cast(self.store.schema)
            own, self.fresh = pa.concat_tables([own, made]), pa.concat_tables([self.fresh, made])
        all_rows = pa.concat_tables([found, own]).combine_chunks()
        at = {h: k for k, h in enumerate(all_rows[HASH].to_pylist())}
        out = all_rows.take(pa.array([None if h is None else at[h] for h in hashes], pa.int64()))
        if self.fresh.num_rows >= FLUSH or self.fresh.nbytes >= FLUSH_BYTES:
            self.close()
        return out

    def close(self) -> None:
        fresh, self.fresh = self.fresh, self.store.schema.empty_table()
        if fresh.num_rows:
            self.store.add(fresh)


def get_or_insert(store: Store, texts: Sequence[str | None], compute: Callable[[list[str]], pa.Table], valid: Callable[[pa.Table], pa.Array] | None = None) -> list[dict | None]:
    """The row of each text, from the store or computed once for each text that it lacks and added; None for null."""
    lookup = Lookup(store, compute, valid)
    rows = lookup.rows(texts).to_pylist()
    lookup.close()
    return [None if t is None else row for t, row in zip(texts, rows, strict=True)]
