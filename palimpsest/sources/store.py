"""Snapshots of the engine's tables: immutable folders per table, tenant and number, and one pointer that names the
current set.

A commit writes new folders first and then replaces the pointer in one rename, so readers see all of it or nothing, and
a job that dies before leaves no trace in what they see. A commit belongs to one tenant: it touches no folder of any
other, so its cost doesn't grow with the corpus, and a tenant's rows are read from its own folders alone. Generations are
aliases in the pointer: promoting one is a change of the pointer, not of the data. One writer at a time.

The feed log is only ever appended to, so that a stream can follow its folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.corpus import LIVE
from palimpsest.sources.schemas import TABLES, conform

POINTER = "_CURRENT.json"
#: Appended folders of a table and tenant from which on an append rewrites them as one. The feed log is never rewritten.
MOST_PARTS = 32


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_pointer(self) -> dict:
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{POINTER}")
        if not fs.exists(p):
            return {"number": 0, "tables": {}, "aliases": {}, "settings": {}, "ledger": [], "feed_seq": 0}
        stream = fs.open(p)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_pointer(self, pointer: dict) -> None:
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        fresh = path(f"{self.root}/_tmp-{uuid.uuid4().hex}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path(f"{self.root}/{POINTER}"), options)

    def bootstrap(self, fts_language: str = "simple", log=lambda line: None) -> None:
        """Records the settings and which tables exist; done twice it changes nothing. Refuses another text language."""
        if not re.fullmatch(r"[a-z_]{1,63}", fts_language):
            raise ValueError(f"not the name of a text language: {fts_language!r}")
        p = self._read_pointer()
        have = p["settings"].setdefault("fts_language", fts_language)
        if have != fts_language:
            raise ValueError(f"the store's text language is {have!r}, not {fts_language!r}; rebuild it or open it as {have!r}")
        for name in TABLES:
            if name not in p["ledger"]:
                p["ledger"].append(name)
                log(f"table {name}")
        self._write_pointer(p)

    def number(self) -> int:
        return self._read_pointer()["number"]

    def last_feed_seq(self) -> int:
        return self._read_pointer().get("feed_seq", 0)

    def feed_path(self) -> str:
        """The folder under which the feed log grows; made if it isn't there."""
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.root}/feed_log"))
        return f"{self.root}/feed_log"

    def read(self, name: str, tenant: str | None = None) -> DataFrame:
        """The current rows of a table, or of one tenant's part of it; an empty table before the first commit."""
        of = self._read_pointer()["tables"].get(name, {})
        return self._load(name, [p for t, parts in of.items() if tenant is None or t == tenant for p in parts])

    def _load(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{p}" for p in parts])

    def commit(self, tenant: str, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame] | None = None, aliases: Mapping[str, str | None] | None = None, feed_seq: int | None = None) -> int:
        """Writes new rows of a tenant beside (`append`) or instead of (`replace`) those of each table and makes all current
        at once. An alias of None is removed."""
        p = self._read_pointer()
        number = p["number"] + 1
        scope = hashlib.sha256(tenant.encode()).hexdigest()[:16]
        for name, df, keep in [*((n, d, []) for n, d in (replace or {}).items()), *((n, d, p["tables"].get(n, {}).get(tenant, [])) for n, d in (append or {}).items())]:
            folder = f"{name}/t={scope}/v={number}-{uuid.uuid4().hex[:8]}"
            rows = conform(df, name)
            if len(keep) >= MOST_PARTS and name != "feed_log":
                rows, keep = self._load(name, keep).unionByName(rows), []
            rows.write.parquet(f"{self.root}/{folder}")
            p["tables"].setdefault(name, {})[tenant] = [*keep, folder]
        for k, v in (aliases or {}).items():
            p["aliases"].pop(k, None)
            if v is not None:
                p["aliases"][k] = v
        p["number"], p["feed_seq"] = number, max(p.get("feed_seq", 0), feed_seq or 0)
        self._write_pointer(p)
        return number

    def generation(self, tenant: str, name: str = LIVE) -> str:
        """The physical generation that a name stands for."""
        return self._read_pointer()["aliases"].get(f"{tenant}/{name}", name)

    def promoting(self, tenant: str, generation: str, archive: str) -> dict[str, str]:
        """The aliases that make a staged generation live; what was live gets the archive name."""
        return {f"{tenant}/{LIVE}": generation, f"{tenant}/{archive}": self.generation(tenant)}

    def demoting(self, tenant: str, archive: str) -> dict[str, str | None]:
        """The aliases that make the archived generation live again; what was live gets its own name back."""
        return {f"{tenant}/{LIVE}": self.generation(tenant, archive), f"{tenant}/{archive}": None}

    def versions(self, tenant: str | None = None) -> DataFrame:
        """Version rows under the names that their generations go by. The names are a small table that is joined, so the
        plan doesn't grow with the tenants."""
        named = [(*k.split("/", 1), g) for k, g in self._read_pointer()["aliases"].items()]
        names = self.spark.createDataFrame([(t, g, name) for t, name, g in named if tenant is None or t == tenant], "tenant_id string, generation string, name string")
        v = self.read("version", tenant).join(names, ["tenant_id", "generation"], "left")
        return v.withColumn("generation", F.coalesce("name", "generation")).select(*TABLES["version"].names)
