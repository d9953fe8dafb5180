"""A store of tables in versions: a version is read whole or not at all, and of two writers that begin at one version one is refused.

A writer puts its tables into a folder of its own, of which nobody knows, and then one small file, the manifest of the version, in its place by a rename that fails if there is one already. Until then readers see
the version before; a writer that dies leaves only a folder, which vacuum() clears. The folder must be on a file system whose rename is atomic and can refuse to replace, as HDFS.
A table that did not change is named again by its old place, not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Someone else wrote a version after the one that this writer began with."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_of = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._fs_of.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the versions that were finished, in order."""
        folder = self._at(f"{self.path}/manifests")
        if not self._fs().exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs().listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._at(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the newest by default; none before the first."""
        number = self.latest() if version is None else version
        if not number:
            return {}
        told = self._manifest(number)["tables"]
        out = {}
        for name, t in told.items():
            out[name] = self.spark.read.schema(t["schema"]).parquet(f"{self.path}/{t['place']}")
            out[name]._store_place = (self.path, t)
        return out

    def save(self, tables: dict[str, DataFrame], base: int, note: dict | None = None) -> int:
        """Writes a version after base, the one that the writer read (0: none), and returns its number; Conflict if base is not the newest any more."""
        if self.latest() != base:
            raise Conflict(f"version {self.latest()} came after {base}")
        made, told = f"data/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            kept = getattr(df, "_store_place", None)
            if kept and kept[0] == self.path:
                told[name] = kept[1]
                continue
            df.write.parquet(f"{self.path}/{made}/{name}")
            told[name] = {"place": f"{made}/{name}", "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        self._publish(base + 1, {"version": base + 1, "tables": told, **(note or {})})
        return base + 1

    def _publish(self, version: int, manifest: dict) -> None:
        folder = f"{self.path}/manifests"
        self._fs().mkdirs(self._at(folder))
        draft, final = self._at(f"{folder}/.draft-{uuid.uuid4().hex}"), self._at(f"{folder}/{version:012d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        how = getattr(self._fs_of, "Options$Rename")
        options = self.spark._sc._gateway.new_array(how, 1)
        options[0] = how.NONE
        context = self._fs_of.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs().getUri(), self._conf)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), options)
        except Exception as e:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise

    def note(self, version: int | None = None) -> dict:
        """What was put down beside the tables of a version."""
        return {k: v for k, v in self._manifest(version or self.latest()).items() if k not in ("tables", "version")}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest versions, and what no version names: also the folder of a writer at work, so not beside one."""
        numbers = self.versions()
        for n in numbers[:-keep]:
            self._fs().delete(self._at(f"{self.path}/manifests/{n:012d}.json"), False)
        used = {t["place"].split("/")[1] for n in numbers[-keep:] for t in self._manifest(n)["tables"].values()}
        data = self._at(f"{self.path}/data")
        gone = [f.getPath() for f in self._fs().listStatus(data) if f.getPath().getName() not in used] if self._fs().exists(data) else []
        for p in gone:
            self._fs().delete(p, True)
        return [p.getName() for p in gone]
