"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

import uuid

from pyspark.sql import DataFrame, functions as F

from packmill.catalog import corpora
from packmill.functions import decode, render, text as tx
from packmill.functions.paths import base_name, depth, order_key, parent, suffix
from packmill.functions.patterns import excluded
from packmill.operators import classify, filters, inventory, links, rules, tree
from packmill.operators.durable import durable, shared_folder
from packmill.operators.ordering import with_position
from packmill.options import PackOptions
from packmill.plans import exact
from packmill.plans.pack import Pack
from packmill.session import ship_package
from packmill.streaming.facts import write_facts

STAMP = "2026-01-01 00:00:00"
GLOBS = ("docs/*", "*.toml", "B_*[0-4].md", "?_1*.txt", "[!a-h]un_*", "src/a_*")
DIRECTORY_GLOBS = ("data/", "docs/deep/", "src", "Pkg/", "/")
PAGE_GLOBS = ("en", "d?", "fr/[0-4]*")
SIZE_LIMIT = 1024

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _path():
    return F.col("rel_path")


def _kept_paths(spark, sf_dir) -> DataFrame:
    reason = F.coalesce(filters.builtin_reason(_path(), F.lit(True)),
                        F.when(filters.is_leftover(_path(), F.lit("file")), "leftover"))
    return corpora.paths(spark, sf_dir).withColumn("ignore_reason", reason)


def _pack(source, **options) -> Pack:
    return Pack(source, PackOptions(generated_at=STAMP, **options))


# ---- path predicates

@query
def ignore_reason_by_layer(spark, sf_dir):
    return _kept_paths(spark, sf_dir).groupBy(
        "project_id", F.coalesce("ignore_reason", F.lit("kept")).alias("layer")).agg(
        F.count("*").alias("files"))


@query
def kept_files(spark, sf_dir):
    return _kept_paths(spark, sf_dir).where("ignore_reason is null").select("project_id", "rel_path")


@query
def path_parts_suffix(spark, sf_dir):
    return corpora.paths(spark, sf_dir).select(
        "project_id", "rel_path", base_name(_path()).alias("name"), parent(_path()).alias("parent"),
        suffix(_path()).alias("suffix"), depth(_path()).cast("long").alias("depth"))


@query
def language_census(spark, sf_dir):
    return corpora.paths(spark, sf_dir).groupBy(
        "project_id", render.language(_path()).alias("language")).agg(F.count("*").alias("files"))


@query
def glob_exclude(spark, sf_dir):
    return corpora.paths(spark, sf_dir).select(
        "project_id", "rel_path", excluded(_path(), F.lit(False), GLOBS).alias("excluded"))


@query
def dir_pattern_exclude(spark, sf_dir):
    return corpora.paths(spark, sf_dir).select(
        "project_id", "rel_path", excluded(_path(), F.lit(False), DIRECTORY_GLOBS).alias("excluded"))


@query
def ancestor_prune(spark, sf_dir):
    return corpora.pages(spark, sf_dir).where(
        ~excluded(_path(), F.lit(False), PAGE_GLOBS)).select("project_id", "rel_path")


@query
def size_cap(spark, sf_dir):
    return corpora.document_files(spark, sf_dir).select(
        "project_id", "rel_path", F.octet_length("content").cast("long").alias("size_bytes"),
        filters.size_reason(F.octet_length("content"), SIZE_LIMIT).alias("skip_reason"))


@query
def human_bytes(spark, sf_dir):
    size = F.octet_length("text").cast("long") * F.pow(F.lit(10), F.col("doc_id") % 5).cast("long")
    return corpora.documents(spark, sf_dir).select(
        "doc_id", size.alias("size_bytes"), tx.human_bytes(size).alias("size_text"))


@query
def parse_size(spark, sf_dir):
    number = F.length("text").cast("string")
    form = F.col("doc_id") % 9
    value = (F.when(form == 0, number).when(form == 1, F.concat(number, F.lit("B")))
             .when(form == 2, F.concat(F.lit("  "), number, F.lit(" kb "))).when(
                 form == 3, F.concat(number, F.lit(".5MB")))
             .when(form == 4, F.concat(number, F.lit("GB"))).when(form == 5, F.concat(number, F.lit("XB")))
             .when(form == 6, F.lit("0.5B")).when(form == 7, F.concat(F.lit("0."), number, F.lit("Kb")))
             .otherwise(F.concat(F.lit("-"), number)))
    return corpora.documents(spark, sf_dir).select(
        "doc_id", value.alias("size_text"), tx.parse_size_col(value).alias("size_bytes"))


# ---- ignore files

def _ignore_files(spark, sf_dir):
    files = corpora.document_bytes(spark, sf_dir).where("rule_kind is not null")
    return rules.ignore_files(inventory.manifest(files.select("project_id", "rel_path", "content")))


@query
def ignore_files_found(spark, sf_dir):
    return _ignore_files(spark, sf_dir).select("project_id", "dir", "name")


@query
def ignore_file_lines(spark, sf_dir):
    return rules.ignore_lines(_ignore_files(spark, sf_dir)).select(
        "project_id", "dir", "name", F.col("line_no").cast("long").alias("line_no"), "line")


def _rules(spark, sf_dir):
    return rules.rules(rules.ignore_lines(_ignore_files(spark, sf_dir)))


@query
def rules_rebased(spark, sf_dir):
    return _rules(spark, sf_dir).select(
        "project_id", "dir", F.col("rule_order.line_no").cast("long").alias("line_no"),
        F.col("rule_order.is_tool").alias("is_tool"), "line", "ignore", "dir_only")


@query
def rules_ordered(spark, sf_dir):
    return with_position(_rules(spark, sf_dir).select("project_id", "rule_order", "line"),
                         ["project_id"], ["rule_order"], "rule_no").select(
        "project_id", "rule_no", "line")


@query
def rules_last_match(spark, sf_dir):
    entries = inventory.manifest(corpora.paths(spark, sf_dir).select("project_id", "rel_path"))
    programs = rules.programs(_rules(spark, sf_dir))
    verdicts = rules.directory_verdicts(inventory.directories(entries), programs)
    return rules.with_verdict(entries, verdicts).select("project_id", "rel_path", "rule_ignored")


@query
def all_layers(spark, sf_dir):
    """Built-in layers, globs, ignore files and leftovers together."""
    source = corpora.paths(spark, sf_dir).select("project_id", "rel_path")
    options = PackOptions(exclude_patterns=("src/a_*", "data/"), output_path="docs/dist")
    return classify.classify(source, options, _ignore_files(spark, sf_dir)).entries.select(
        "project_id", "rel_path", F.coalesce("ignore_reason", F.lit("kept")).alias("layer"))


# ---- decoding

def _decoded(spark, sf_dir):
    content = F.col("content")
    return corpora.document_bytes(spark, sf_dir).withColumn("encoding", decode.encoding(content)).select(
        "project_id", "rel_path", "byte_kind", "rule_kind", "encoding",
        decode.skip_reason(content).alias("skip_reason"),
        decode.text(content, F.col("encoding")).alias("text"))


@query
def encoding_census(spark, sf_dir):
    content = F.col("content")
    return corpora.document_bytes(spark, sf_dir).groupBy(
        F.coalesce(decode.encoding(content), F.lit("none")).alias("encoding")).agg(
        F.count("*").alias("files"))


@query
def decoded_text(spark, sf_dir):
    return _decoded(spark, sf_dir).select(
        "project_id", "rel_path", F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.length("text").cast("long").alias("chars"))


@query
def decode_utf16_utf32(spark, sf_dir):
    return _decoded(spark, sf_dir).where("encoding in ('utf-16', 'utf-32')").select(
        "project_id", "rel_path", "encoding", "text")


@query
def binary_sniff(spark, sf_dir):
    return corpora.document_bytes(spark, sf_dir).select(
        "project_id", "rel_path", decode.looks_binary(F.col("content")).alias("has_nul"))


@query
def skip_reasons(spark, sf_dir):
    content = F.col("content")
    reason = F.coalesce(filters.size_reason(F.octet_length(content), 9000), decode.skip_reason(content))
    return corpora.document_bytes(spark, sf_dir).select(
        "project_id", "rel_path", reason.alias("skip_reason")).where("skip_reason is not null")


@query
def transcoded_files(spark, sf_dir):
    return _decoded(spark, sf_dir).where(decode.transcoded(F.col("encoding"))).select(
        "project_id", "rel_path", "encoding")


@query
def streamed_facts(spark, sf_dir):
    """Facts of all files, taken by a stream that ends when it has read what is there."""
    folder = f"{shared_folder(spark)}/facts-{uuid.uuid4()}"
    write_facts(corpora.document_stream(spark, sf_dir), f"{folder}/rows", f"{folder}/progress",
                PackOptions(exclude_patterns=("src/a_*", "data/"), max_file_size="9000B")).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(
        "project_id", "rel_path", "name", "parent", "suffix", "depth", "language", "ignore_reason", "size_bytes",
        "skip_reason", "encoding", "lines", "tokens", "text_md5")


# ---- text statistics

@query
def line_counts(spark, sf_dir):
    return corpora.ticked_documents(spark, sf_dir).select(
        "doc_id", tx.line_count(F.col("text")).alias("lines"))


@query
def token_heuristic(spark, sf_dir):
    return corpora.documents(spark, sf_dir).select(
        "doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query
def tokens_exact(spark, sf_dir):
    """With the exact tokenizer where its vocabulary is at hand, else by the heuristic."""
    ship_package(spark)
    rows = corpora.documents(spark, sf_dir).withColumn("exact", exact.count_tokens(F.col("text")))
    return rows.select("doc_id", F.coalesce("exact", tx.token_count(F.col("text"))).alias("tokens"),
                       F.col("exact").isNotNull().alias("is_exact"))


@query
def project_totals(spark, sf_dir):
    pack = _pack(corpora.document_files(spark, sf_dir), include_tree=False, token_counting="off")
    return pack.report.select("project_id", "packed_count", "failed_count", "total_source_lines",
                              "estimated_tokens", "token_method")


# ---- order

@query
def content_order(spark, sf_dir):
    rows = _kept_paths(spark, sf_dir).where("ignore_reason is null").select(
        "project_id", "rel_path", order_key(_path(), F.lit(False)).alias("sort_key"))
    return with_position(rows, ["project_id"], ["sort_key"], "position").drop("sort_key")


def _path_nodes(files: DataFrame) -> DataFrame:
    entries = inventory.manifest(files)
    dirs = inventory.directories(entries)
    found = entries.select("project_id", "rel_path", "kind", "link_target",
                           F.lit(None).cast("string").alias("skip_reason"))
    return tree.directory_nodes(dirs).unionByName(tree.file_nodes(found))


@query
def tree_order(spark, sf_dir):
    nodes = _path_nodes(corpora.paths(spark, sf_dir).select("project_id", "rel_path"))
    return with_position(nodes.select("project_id", "path", "sort_key"), ["project_id"], ["sort_key"],
                         "position").drop("sort_key")


@query
def last_sibling(spark, sf_dir):
    nodes = _path_nodes(corpora.pages(spark, sf_dir).select("project_id", "rel_path"))
    return tree.siblings(nodes).select("project_id", "dir", "last_child", "children")


# ---- trees

def _numbered(lines: DataFrame) -> DataFrame:
    return with_position(lines, ["project_id"], ["sort_key"], "line_no").select(
        "project_id", "line_no", "line")


def _projects(df: DataFrame) -> DataFrame:
    return df.select("project_id").distinct().withColumn(
        "project_name", F.substring_index("project_id", "/", -1))


@query
def dir_inventory(spark, sf_dir):
    entries = inventory.manifest(corpora.paths(spark, sf_dir).select("project_id", "rel_path"))
    return inventory.directories(entries).where("dir <> ''").select("project_id", "dir", "entries")


@query
def tree_lines(spark, sf_dir):
    files = corpora.pages(spark, sf_dir).select("project_id", "rel_path")
    return _numbered(tree.tree_lines(_path_nodes(files), _projects(files)))


@query
def tree_with_skips(spark, sf_dir):
    return _numbered(_pack(corpora.document_files(spark, sf_dir), max_file_size=9000).tree)


def _linked(spark, sf_dir):
    return links.resolve_links(durable(corpora.linked_manifest(spark, sf_dir)))


@query
def link_containment(spark, sf_dir):
    return _linked(spark, sf_dir).where("kind = 'link'").select(
        "project_id", "rel_path", "resolved_rel_path", "target_kind",
        F.col("resolved_rel_path").isNull().alias("outside_root"))


@query
def link_suffixes(spark, sf_dir):
    rows = corpora.linked_manifest(spark, sf_dir).where("kind <> 'dir'")
    return rows.select("project_id", "rel_path", F.concat(base_name(_path()), tree.link_suffix(
        F.col("kind"), F.col("link_target"))).alias("label"))


@query
def duplicate_dirs(spark, sf_dir):
    dirs = corpora.linked_manifest(spark, sf_dir).where("kind = 'dir'").select(
        "project_id", F.col("rel_path").alias("dir"), "dir_id")
    kept = dirs.where(filters.builtin_reason(F.col("dir"), F.lit(False)).isNull())
    return inventory.repeated_directories(kept).select("project_id", "dir")


def _classified_links(spark, sf_dir):
    return classify.classify(_linked(spark, sf_dir), PackOptions(output_path="links/out.txt"))


@query
def linked_entries(spark, sf_dir):
    """What each entry of the manifest with links comes to: links to files are packed under
    their own path, links to directories never entered, repeats dropped."""
    entries = _classified_links(spark, sf_dir).entries.where("kind <> 'dir'")
    fate = F.coalesce("ignore_reason", F.when(F.col("is_file"), "packed").otherwise("shown"))
    return entries.select("project_id", "rel_path", fate.alias("fate"))


@query
def output_self_exclusion(spark, sf_dir):
    """The output folder, what lies in it and links to that are left out; so is a leftover at
    the root only."""
    options = PackOptions(output_path="docs/deep")
    entries = classify.classify(_linked(spark, sf_dir), options).entries
    return entries.where("kind <> 'dir' and ignore_reason in ('output_file', 'leftover')").select(
        "project_id", "rel_path", "ignore_reason")


@query
def extra_filter_layer(spark, sf_dir):
    """A condition on files and links; what it leaves out keeps its directory in the tree."""
    source = corpora.linked_manifest(spark, sf_dir).where("kind = 'file'").select("project_id", "rel_path")
    options = PackOptions(extra_filter="rel_path not like '%e_%' and nullif(length(rel_path) % 5, 4) >= 0")
    found = classify.classify(source, options)
    files = found.entries.select("project_id", F.col("rel_path").alias("path"),
                                 F.coalesce("ignore_reason", F.lit("kept")).alias("layer"))
    return files.unionByName(found.dirs.select("project_id", F.col("dir").alias("path"), F.lit("directory").alias("layer")))


@query
def tree_links(spark, sf_dir):
    source = _linked(spark, sf_dir)
    classified = classify.classify(source, PackOptions())
    files = classified.entries.where("is_file and ignore_reason is null").select(
        "project_id", "rel_path", "kind", "link_target", F.lit(None).cast("string").alias("skip_reason"))
    nodes = tree.directory_nodes(classified.dirs).unionByName(tree.file_nodes(files)).unionByName(
        tree.link_nodes(classified))
    return _numbered(tree.tree_lines(nodes, _projects(source), tree.directory_notes(classified)))


# ---- rendering

@query
def fence_length(spark, sf_dir):
    ticks = render.longest_ticks(F.col("text"))
    return corpora.ticked_documents(spark, sf_dir).select(
        "doc_id", ticks.cast("long").alias("longest_run"), render.fence(F.col("text")).alias("fence"))


@query
def text_blocks(spark, sf_dir):
    block = render.file_block(_path(), F.col("text"), "text")
    return corpora.ticked_documents(spark, sf_dir).select("doc_id", F.md5(block.cast("binary")).alias("block_md5"),
                                                          F.length(block).cast("long").alias("chars"))


@query
def markdown_blocks(spark, sf_dir):
    block = render.file_block(_path(), F.col("text"), "markdown")
    return corpora.ticked_documents(spark, sf_dir).select("doc_id", F.md5(block.cast("binary")).alias("block_md5"),
                                                          F.length(block).cast("long").alias("chars"))


@query
def header_text(spark, sf_dir):
    return _pack(corpora.document_files(spark, sf_dir)).stats.select("project_id", "header")


@query
def header_markdown(spark, sf_dir):
    return _pack(corpora.document_files(spark, sf_dir), output_format="markdown").stats.select(
        "project_id", "header")


@query
def document_measures(spark, sf_dir):
    """Lines, estimated tokens and bytes of Markdown documents without a tree."""
    report = _pack(corpora.document_files(spark, sf_dir), output_format="markdown",
                   include_tree=False).report
    return report.select("project_id", "total_lines", "estimated_tokens", "file_size")


# ---- whole documents

def _document(pack: Pack) -> DataFrame:
    return pack.numbered


@query
def pack_text(spark, sf_dir):
    return _document(_pack(corpora.conversations(spark, sf_dir)))


@query
def pack_markdown(spark, sf_dir):
    return _document(_pack(corpora.conversations(spark, sf_dir), output_format="markdown"))


@query
def pack_text_no_tree(spark, sf_dir):
    return _document(_pack(corpora.conversations(spark, sf_dir), include_tree=False))


@query
def pack_markdown_no_tree(spark, sf_dir):
    return _document(_pack(corpora.conversations(spark, sf_dir), output_format="markdown",
                           include_tree=False))


@query
def pack_report(spark, sf_dir):
    """The whole pipeline over documents in many encodings, with globs, ignore files and a
    size limit."""
    return _pack(corpora.document_files(spark, sf_dir), max_file_size="9000B",
                 exclude_patterns=("src/a_*", "data/")).report


@query
def pages_site_pack(spark, sf_dir):
    return _pack(corpora.pages(spark, sf_dir), output_format="markdown",
                 exclude_patterns=PAGE_GLOBS).report


def flagship(spark, sf_dir):
    return pack_report(spark, sf_dir)
