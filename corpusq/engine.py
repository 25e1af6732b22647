"""The engine over one catalog: indexing, search and text tools, and the same as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.config import resolve
from corpusq.functions.text import LIBRARY_STOP_WORDS, STOP_WORDS, line_slice
from corpusq.lineage import cut
from corpusq.operators import bm25, changes, clues, lines, segmentation, tree, vectors
from corpusq.plans import indexing, retrieval
from corpusq.sources.catalog import SCHEMAS, Catalog


class Engine:
    def __init__(self, spark: SparkSession, root: str, tenant: str | None = None, settings: dict | None = None, provider=None):
        self.spark, self.settings = spark, resolve(settings)
        self.catalog = Catalog(spark, root, tenant)
        self.provider = provider or indexing.HashingEmbedder(self.settings["embedding"]["dimension"])

    def index(self, folder: str, project: str) -> str | None:
        sizes = self.settings["indexing"]["chunk_size"]
        return indexing.index(self.catalog, folder, project, provider=self.provider, least=sizes["min_tokens"], most=sizes["max_tokens"], style=self._style())

    def _style(self) -> str:
        return "words" if self.settings["indexing"]["segment"] else "index"

    def ingest(self, fetched: DataFrame, project: str, folder: str = "urls") -> str:
        """Commit fetched(url, content, error), such as rows of the source ``urls``, as files."""
        sizes = self.settings["indexing"]["chunk_size"]
        return indexing.ingest(self.catalog, project, fetched, folder, provider=self.provider, least=sizes["min_tokens"], most=sizes["max_tokens"], style=self._style())

    def terms(self, text: str, profile: str = "local") -> list[str]:
        import re

        if profile == "cloud":
            return text.lower().split()
        if self._style() == "words":
            return segmentation.Segmenter.of(self.catalog.read("lexicon"), library=profile == "library").terms(text)
        stop = LIBRARY_STOP_WORDS if profile == "library" else STOP_WORDS
        return [w for w in re.findall(r"\w+", text.lower()) if not re.fullmatch("[a-z0-9]", w) and w not in stop]

    def scope(self, paths: list[str] | None) -> list[str] | None:
        """Directories at or below the paths; None for everything."""
        if paths is None:
            return None
        bases = self.spark.createDataFrame([(p.rstrip("/") or ".",) for p in paths], "base string")
        return [r.dir_id for r in tree.scope(self.catalog.read("directories"), bases, "relative_path").select("dir_id").collect()]

    def search(self, query: str, keyword: str | None = None, top_k: int | None = None, paths: list[str] | None = None, profile: str = "local") -> DataFrame:
        chunks = changes.compact(self.catalog.read("chunks"))
        vecs = chunks.select("chunk_id", "dir_id", F.col("content_vector").alias("embedding"))
        vector = self.provider.embed([query])[0]
        status = self.catalog.read("files") if profile == "cloud" else None
        return retrieval.search(chunks, self.catalog.read("postings"), vecs, vector, query, self.terms(keyword or query, profile), top_k or self.settings["search"]["default_top_k"], profile, self.scope(paths), keyword, status=status)

    def search_results(self, query: str, keyword: str | None = None, top_k: int | None = None, paths: list[str] | None = None, profile: str = "local") -> DataFrame:
        """Results as they are shown: path, locator, text and summary, up to three keyword snippets, and the clues that name the file."""
        k = top_k or self.settings["search"]["default_top_k"]
        chunks, archives, files = changes.compact(self.catalog.read("chunks")), self.catalog.read("archives"), self.catalog.read("files")
        # At most k rows, read three times below.
        best = cut(self.search(query, keyword, k, paths, profile).drop("content", "snippet"))
        out = retrieval.hydrate(best, chunks, archives, files)
        if keyword and keyword.strip():
            hits = bm25.search(self.catalog.read("postings"), self.terms(keyword, profile), profile, self.scope(paths), 3 * k).select("chunk_id", "score").join(chunks.select("chunk_id", "file_id"), "chunk_id")
            hits = cut(hits)
            out = out.join(retrieval.file_snippets(hits, best, keyword, chunks, archives, files), "file_id", "left")
        else:
            out = out.withColumn("snippets", F.lit(None).cast("array<struct<chunk_id:string,locator:string,text:string>>"))
        if profile == "cloud":
            return out.orderBy(*retrieval.by_score())
        nodes = tree.paths(self.catalog.read("clue_nodes")) if self.catalog.exists("clue_nodes") else self.catalog.read("clue_nodes").withColumn("path", F.lit(""))
        return out.join(clues.references(self.catalog.read("clues"), nodes, best), "file_id", "left").orderBy(*retrieval.by_score())

    # Curated trees: every change is a commit of both tables.

    def clue_list(self, project: str | None = None) -> DataFrame:
        return clues.listing(self.catalog.read("clues"), self.catalog.read("clue_nodes"), project)

    def clue_create(self, project: str, name: str, description: str = "", principle: str = "", organization: str = "tree", time_format: str | None = None) -> str:
        clue, own = clues.create(self.spark, project, name, description, principle, organization, time_format)
        both = clues.save(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue, own)
        self.catalog.commit(clues=both[0], clue_nodes=both[1])
        return clue.first()["clue_id"]

    def clue_nodes(self, clue_id: str, path: str = "") -> DataFrame:
        """Nodes of a clue with their paths, at or below a path, in the tree's order."""
        own = clues.get(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)[1]
        return tree.subtree(tree.paths(own), path).orderBy("order")

    def clue_tree(self, clue_id: str, depth: int | None = None) -> str:
        """The clue as a drawing, under its name."""
        name = self.catalog.read("clues").where(F.col("clue_id") == clue_id).first()
        rows = [r.asDict() for r in clues.get(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)[1].collect()]
        return tree.render([r | ({"name": name["name"]} if r["parent_id"] is None else {}) for r in rows], depth)

    def _clue_commit(self, clue_id: str, own: DataFrame) -> None:
        rest = self.catalog.read("clue_nodes").where(F.col("clue_id") != clue_id)
        stamp = self.catalog.read("clues").withColumn("updated_at", F.when(F.col("clue_id") == clue_id, F.current_timestamp()).otherwise(F.col("updated_at")))
        self.catalog.commit(clues=stamp, clue_nodes=rest.unionByName(own.select(*rest.columns)))

    def clue_add(self, clue_id: str, parent: str, name: str, kind: str = "folder", position: int | None = None, **values) -> None:
        """A folder or leaf under the folder at a path of names."""
        own = clues.get(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)[1]
        up = tree.find(tree.paths(own), parent).first()
        if up is None:
            raise ValueError(f"there is no node at {parent!r}")
        import uuid

        given = values | {"clue_id": clue_id, "node_id": uuid.uuid4().hex, "parent_id": up["node_id"], "kind": kind, "name": name.strip()}
        row = self.spark.createDataFrame([tuple(given.get(f.name) for f in own.schema)], own.schema)
        self._clue_commit(clue_id, tree.add_child(own, up["node_id"], row, position))

    def clue_update(self, clue_id: str, path: str, **values) -> None:
        own = clues.get(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)[1]
        at = tree.find(tree.paths(own), path).first()
        if at is None or at["parent_id"] is None:
            raise ValueError(f"there is no node below the root at {path!r}")
        self._clue_commit(clue_id, tree.update(own, at["node_id"], **values))

    def clue_remove(self, clue_id: str, path: str) -> None:
        """Without the node at a path of names and all below it; every other row of the catalog stays as it is."""
        own = clues.get(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)[1]
        found = tree.paths(own)
        at = "/".join(x.strip() for x in path.split("/") if x.strip())
        if not at or tree.find(found, at).isEmpty():
            raise ValueError(f"there is no node below the root at {path!r}")
        self._clue_commit(clue_id, own.join(tree.subtree(found, at).select("node_id"), "node_id", "left_anti"))

    def clue_delete(self, clue_id: str) -> None:
        both = clues.delete(self.catalog.read("clues"), self.catalog.read("clue_nodes"), clue_id)
        self.catalog.commit(clues=both[0], clue_nodes=both[1])

    def keyword_search(self, text: str, top_k: int | None = None, paths: list[str] | None = None) -> DataFrame:
        return bm25.search(self.catalog.read("postings"), self.terms(text), dirs=self.scope(paths), top_k=top_k or self.settings["search"]["default_top_k"])

    def vector_search(self, query: str, top_k: int | None = None, metric: str = "cosine", paths: list[str] | None = None) -> DataFrame:
        dirs = self.scope(paths)
        rows = changes.compact(self.catalog.read("chunks"))
        where = None if dirs is None else F.col("dir_id").isin(*dirs)
        return vectors.knn(rows, self.provider.embed([query])[0], top_k or self.settings["search"]["default_top_k"], metric, where=where, vector="content_vector", key="chunk_id")

    def documents(self) -> DataFrame:
        return self.catalog.read("files").join(self.catalog.read("archives").select("file_id", F.col("content_md").alias("content")), "file_id")

    def grep(self, needle: str, pattern: str | None = None, **options) -> DataFrame:
        return lines.grep(lines.select_files(self.documents(), pattern=pattern), needle, **options)

    def glob(self, pattern: str, limit: float = 100) -> DataFrame:
        return lines.glob(self.catalog.read("files"), pattern, limit=limit)

    def read(self, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """One file, by id or path."""
        one = self.documents().where((F.col("file_id") == path) | (F.col("path") == path)).orderBy("path").limit(1)
        return lines.read_lines(one, first, last).select("file_id", "path", "content", "total_lines")

    def get_chunk(self, chunk_id: str, around: int = 0) -> DataFrame:
        """A chunk with its section's text, and its neighbours."""
        rows = changes.compact(self.catalog.read("chunks"))
        hit = rows.where(F.col("chunk_id") == chunk_id)
        near = lines.neighbours(rows, hit, around).select(*rows.columns) if around else rows.limit(0)
        text = self.catalog.read("archives").select("file_id", "content_md")
        out = hit.unionByName(near).join(text, "file_id", "left")
        return out.select("chunk_id", "file_id", "idx", "content", line_slice(F.col("content_md"), F.col("line_start"), F.col("line_end")).alias("section_text"), (F.col("chunk_id") == chunk_id).alias("hit")).orderBy("idx")

    def tree(self, depth: int = 2) -> DataFrame:
        d = self.catalog.read("directories").select(F.col("dir_id").alias("id"), F.col("parent_dir_id").alias("parent_id"), "relative_path", "file_count", "chunk_count")
        levels = tree.expand(d, d.where("parent_id is null"), max(0, int(depth)))
        return levels.join(d, "id").select("level", "relative_path", "file_count", "chunk_count").orderBy("level", "relative_path")

    def purge(self, paths: list[str]) -> str:
        """Drop the directories at or below the paths with all that hangs on them."""
        gone = self.scope(paths) or []
        keep = lambda name: self.catalog.read(name).where(~F.col("dir_id").isin(*gone)) if gone else self.catalog.read(name)
        files = keep("files")
        return self.catalog.commit(chunks=keep("chunks"), postings=keep("postings"), files=files, directories=keep("directories"), archives=self.catalog.read("archives").join(files.select("file_id"), "file_id", "left_semi"))

    def views(self) -> list[str]:
        """Temporary views of the current tables, for SQL."""
        for name in SCHEMAS:
            self.catalog.read(name).createOrReplaceTempView(name)
        return list(SCHEMAS)



