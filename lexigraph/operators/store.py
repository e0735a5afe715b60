"""Versioned Parquet tables: keyed upserts, appends, atomic replacement of one or several tables.

The store's state is its last commit: a file that lists each table's folders. A commit is written aside and renamed to the
next number, which fails if that is taken, so readers see all tables of a commit or none, and two writers cannot both
follow one commit. An append adds a folder and rewrites nothing. Paths go through Hadoop's file system, whatever store
they name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.text import author_key, searchable_text, stable_id
from lexigraph.operators.index import with_vectors
from lexigraph.schemas import TABLES, columns
from lexigraph.session import shuffles_removed

#: What must be unique in a table.
KEYS = {"publications": "publication_key", "authors": "author_key", "crawl_runs": "run_id", "idf": "term", "document_vectors": "publication_key", "index_metadata": "name"}
#: Folders of a table from which an append writes them as one; commits that ``vacuum`` keeps.
MOST_FOLDERS, KEPT_COMMITS = 64, 2
COMMITS = "_commits"
#: Halves hexadecimal keys, which the default leaves as they are.
CODEC = "zstd"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def check(self) -> None:
        """Raises if the root cannot be reached or made."""
        if not self._fs().mkdirs(self._path()):
            raise RuntimeError(f"the store {self.root} cannot be made")

    def commits(self) -> list[int]:
        folder = self._path(COMMITS)
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, commit: int | None = None) -> tuple[int, dict[str, list[str]]]:
        """The number of the last (or the given) commit and each table's folders."""
        commit = max(self.commits(), default=0) if commit is None else commit
        if not commit:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/{COMMITS}/{commit:012d}", wholetext=True).first()[0]
        return commit, json.loads(text)

    def version(self, table: str) -> list[str] | None:
        """The folders that hold a table now."""
        return self.state()[1].get(table)

    def _commit(self, after: int, tables: dict[str, list[str]]) -> None:
        jvm, name = self.spark._jvm, uuid.uuid4().hex
        aside = self._path(COMMITS, f"_{name}")
        out = self._fs().create(aside, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(aside, self._path(COMMITS, f"{after + 1:012d}"), none)

    def read(self, table: str) -> DataFrame:
        folders = self.state()[1].get(table)
        if not folders:
            if table not in TABLES:
                raise RuntimeError(f"the store has no table {table}")
            return self.spark.createDataFrame([], TABLES[table])
        reader = self.spark.read.schema(TABLES[table] + HELD.get(table, "")) if table in TABLES else self.spark.read
        rows = reader.parquet(*(f"{self.root}/{table}/{f}" for f in folders))
        return FULL[table](rows) if table in FULL else rows

    def _written(self, table: str, df: DataFrame) -> str:
        """A new folder with the rows, which nothing refers to yet; raises if they repeat what must be unique."""
        folder = uuid.uuid4().hex
        with shuffles_removed(self.spark):
            (LEAN[table](df) if table in LEAN else df).write.option("compression", CODEC).parquet(f"{self.root}/{table}/{folder}")
            if table in KEYS and not repeated(self.spark.read.parquet(f"{self.root}/{table}/{folder}"), KEYS[table]).isEmpty():
                raise ValueError(f"{table} repeats {KEYS[table]}")
        return folder

    def replace_all(self, tables: dict[str, DataFrame] | Iterable[tuple[str, DataFrame]]) -> None:
        """Writes new versions of the tables one after another, then makes all of them visible at once.

        A table that is given several times holds the rows of all, unless it has what must be unique.
        """
        after, held = self.state()
        new: dict[str, list[str]] = {}
        for name, df in tables.items() if isinstance(tables, dict) else tables:
            if name in new and name in KEYS:
                raise ValueError(f"{name} is given twice")
            new.setdefault(name, []).append(self._written(name, df))
        self._commit(after, held | new)

    def replace(self, table: str, df: DataFrame) -> DataFrame:
        self.replace_all({table: df})
        return self.read(table)

    def append(self, table: str, df: DataFrame) -> None:
        after, held = self.state()
        folders = held.get(table, [])
        if len(folders) >= MOST_FOLDERS:
            self.replace(table, self.read(table).unionByName(df))
        else:
            self._commit(after, held | {table: [*folders, self._written(table, df)]})

    def vacuum(self, keep: int = KEPT_COMMITS) -> None:
        """Deletes folders that the last ``keep`` commits do not list, and older commits. Run it where no other writer is."""
        commits = self.commits()
        states = [self.state(c)[1] for c in commits[-keep:]]
        for status in self._fs().listStatus(self._path()):
            table = status.getPath().getName()
            if table != COMMITS and status.isDirectory():
                used = {f for s in states for f in s.get(table, [])}
                for folder in self._fs().listStatus(status.getPath()):
                    if folder.getPath().getName() not in used:
                        self._fs().delete(folder.getPath(), True)
        for c in commits[:-keep]:
            self._fs().delete(self._path(COMMITS, f"{c:012d}"), False)

    def upsert_publications(self, batch: DataFrame, order: str = "ord") -> int:
        """Later rows of a key win; first_seen_at stays. Returns how many were new or written anew, which is all of them."""
        rows = publication_rows(batch, order)
        by = latest_by_key(keyed(batch).select("publication_key", "authors", "updated_at", order), "publication_key", order)  # without texts
        fresh = rows.select(*[c for c in columns("publications") if c != "first_seen_at"])
        self.replace_all({
            "authors": merged_authors(self.read("authors"), author_rows(by)),
            "publications": upserted(self.read("publications") if self.version("publications") else None, fresh, "publication_key"),
        })
        return rows.count()

    def save_run(self, run: DataFrame) -> str:
        run_id = uuid.uuid4().hex
        self.append("crawl_runs", run.withColumn("run_id", F.lit(run_id)).select(*columns("crawl_runs")))
        return run_id

    def repeated_keys(self, table: str, key: str) -> DataFrame:
        return repeated(self.read(table), key)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that several rows have."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("row")).select("row.*")


def publication_rows(batch: DataFrame, order: str = "ord") -> DataFrame:
    """Records with their key, author keys, search text and update time, one a key. Texts move only if a key is repeated."""
    rows = keyed(batch)
    once = repeated(rows, "publication_key").isEmpty()
    return (rows if once else latest_by_key(rows, "publication_key", order)).withColumn("searchable_text", searchable_text())


def keyed(batch: DataFrame) -> DataFrame:
    rows = batch.withColumn("publication_key", stable_id(F.col("publication_url")))
    for name in ("published_date", "source", "abstract", "crawled_from"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "crawled_at" not in rows.columns:
        rows = rows.withColumn("crawled_at", F.current_timestamp())
    rows = rows.withColumns({
        "author_keys": F.transform("authors", lambda a: author_key(a["name"], a["profile_url"])),
        "authors": F.transform("authors", lambda a: F.struct(a["name"].alias("name"), a["profile_url"].alias("profile_url"), a["affiliation"].alias("affiliation"))),
        "updated_at": F.current_timestamp(),
    })
    return rows


def lean_publications(rows: DataFrame) -> DataFrame:
    """Without the search text where the other fields, which it repeats, give it."""
    return rows.withColumns({"searchable_text": F.when(~F.col("searchable_text").eqNullSafe(searchable_text()), F.col("searchable_text")), "searchable_is_null": F.col("searchable_text").isNull()})


def full_publications(rows: DataFrame) -> DataFrame:
    given = F.when(~F.coalesce("searchable_is_null", F.lit(False)), F.coalesce("searchable_text", searchable_text()))
    return rows.withColumn("searchable_text", given).drop("searchable_is_null")


#: Tables whose stored form leaves out what the rest gives: to it, its further columns, and from it.
LEAN, HELD, FULL = {"publications": lean_publications}, {"publications": ", searchable_is_null boolean"}, {"publications": full_publications, "document_vectors": with_vectors}


def upserted(old: DataFrame | None, new: DataFrame, key: str, first_seen: str = "first_seen_at", now: str = "updated_at") -> DataFrame:
    """All rows of both; a new row replaces the old one of its key but for when it was first seen."""
    if old is None:
        return new.select("*", F.col(now).alias(first_seen))
    o, n = old.alias("o"), new.alias("n")
    fresh = F.col(f"n.{key}").isNotNull()
    columns = [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in new.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns, F.coalesce(F.col(f"o.{first_seen}"), F.col(f"n.{now}")).alias(first_seen))


def author_rows(publications: DataFrame) -> DataFrame:
    """One row an author: the last name and profile, and the set of publications."""
    each = publications.select("publication_key", "updated_at", F.posexplode("authors").alias("place", "a"))
    each = each.select(author_key(F.col("a.name"), F.col("a.profile_url")).alias("author_key"), "a.*", "publication_key", "updated_at", "place")
    last = F.struct("updated_at", "publication_key", "place")
    return each.groupBy("author_key").agg(*(F.max_by(c, last).alias(c) for c in ("name", "profile_url", "affiliation", "updated_at")), F.array_sort(F.collect_set("publication_key")).alias("publication_keys"))


def merged_authors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names are replaced, publications only added."""
    both = upserted(old.drop("publication_keys"), new.drop("publication_keys"), "author_key")
    none = F.array().cast("array<string>")
    keys = old.select("author_key", F.col("publication_keys").alias("before")).join(new.select("author_key", F.col("publication_keys").alias("after")), "author_key", "full")
    keys = keys.select("author_key", F.array_sort(F.array_union(F.coalesce("before", none), F.coalesce("after", none))).alias("publication_keys"))
    return both.join(keys, "author_key").select(*columns("authors"))
