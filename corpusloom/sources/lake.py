"""Tables of a knowledge base on a file system: Parquet folders, a log of commits, and JSON configs.

Every write goes to a folder of its own, which nobody reads until a commit names
it.  A commit is one small file that lists the folders of all tables, so a change
of several tables holds wholly or not at all; what a failed write leaves behind is
never read.  Commits are numbered, and a number can be taken once: of two writers
the slower one adds its folders to what the faster one committed, or, if it
replaces a table that has changed meanwhile, is refused.  Paths may be local or of
any file system Spark knows (s3a://, hdfs://, …).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(f"{self.root}/{path}")
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        """Whether there was something to delete."""
        fs, p = self._fs(f"{self.root}/{path}")
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{path}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def save_json(self, path: str, value) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            out.close()

    def load_json(self, path: str):
        """The value, or None if the file is missing or no JSON."""
        fs, p = self._fs(f"{self.root}/{path}")
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            source.close()

    def state(self) -> tuple[int, dict[str, list[dict]]]:
        """Number of the last commit (0: none) and the folders of each table by it."""
        for name in reversed(self.names("_commits")):
            held = self.load_json(f"_commits/{name}")
            if held is not None:  # else a writer was lost while it wrote the file
                return int(name.split(".")[0]), held
        return 0, {}

    def read(self, table: str) -> DataFrame | None:
        folders = self.state()[1].get(table)
        if not folders:
            return None
        read = lambda paths: self.spark.read.option("mergeSchema", "true").parquet(*paths)
        path = lambda f: f"{self.root}/{table}/{f['folder']}"
        plain = [path(f) for f in folders if not f["by"]]
        frames = ([read(plain)] if plain else []) + [read([path(f)]) for f in folders if f["by"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def write(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> dict:
        """Rows in a folder of the table that no commit names yet."""
        folder = f"v{self.state()[0] + 1}-{uuid.uuid4().hex[:12]}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{folder}")
        return {"folder": folder, "by": partition_by or []}

    def commit(self, append: dict[str, dict] | None = None, replace: dict[str, dict] | None = None, base: int | None = None) -> int:
        """Names written folders of any number of tables at once; base: the commit that what replaces was made from."""
        while True:
            now, tables = self.state()
            changed = base is not None and base != now
            if changed and replace:
                held = self.load_json(f"_commits/{base:010d}.json") or {}
                if any(held.get(t) != tables.get(t) for t in replace):
                    raise RuntimeError("the table was changed by another writer")
            new = dict(tables)
            for table, folder in (append or {}).items():
                new[table] = [*new.get(table, []), folder]
            for table, folder in (replace or {}).items():
                new[table] = [folder]
            number = max([now, *(int(n.split(".")[0]) for n in self.names("_commits"))]) + 1
            if self._create(f"_commits/{number:010d}.json", new):
                self._tidy(number, now, replace or {}, tables)
                return number

    def _create(self, path: str, value) -> bool:
        """Whether the file did not exist before."""
        fs, p = self._fs(f"{self.root}/{path}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            out.close()
        return True

    def _tidy(self, number: int, before: int, replaced: dict, tables: dict[str, list[dict]]) -> None:
        """Drops what was replaced before the last change: its readers had the time of one change to end."""
        old = self.load_json("_replaced.json") or {}
        for table in replaced:
            for folder in old.get(table, []):
                self.delete(f"{table}/{folder}")
            old[table] = [f["folder"] for f in tables.get(table, [])]
        if replaced:
            self.save_json("_replaced.json", old)
        for name in self.names("_commits")[:-100]:
            self.delete(f"_commits/{name}")

    def replace(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """The table becomes these rows; what they replace is kept until the next such change."""
        base = self.state()[0]
        self.commit(replace={table: self.write(table, rows, partition_by)}, base=base)

    def append(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """Rows added to the table, whose columns may grow."""
        self.commit(append={table: self.write(table, rows, partition_by)})
