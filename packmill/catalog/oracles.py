"""ANSI-SQL twins of the registered queries, written independently of the operators:
ancestors, rules, trees and documents are worked out by unnesting and string
aggregation, ignore rules by hand-written expressions."""

from packmill import constants as c
from packmill.catalog import corpora as co
from packmill.catalog.queries import STAMP

NL = "chr(10)"


def _list(values) -> str:
    return ", ".join("'%s'" % v for v in values)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- corpora

DOCS = (f"docs AS (SELECT {co.DOC_PROJECT} AS project_id, {co.DOC_PATH} AS rel_path, {co.DOC_BASE} AS base, "
        f"doc_id, doc_id % 11 AS byte_kind, {co.RULE_KIND} AS rule_kind, text FROM documents)")

TICKED = ("ticked AS (SELECT doc_id, rel_path, concat(replace(text, 'th', repeat('`', CAST(doc_id % 6 AS INT))), "
          "CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END) AS text FROM docs)")

_PLACE = "regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', '')"
_HOST = f"split_part({_PLACE}, '/', 1)"
PAGES = (f"site AS (SELECT {_HOST} AS project_id, trim(substr({_PLACE}, length({_HOST}) + 1), '/') AS folder, "
         "page_id, html FROM pages), "
         f"page_files AS (SELECT project_id, concat(CASE WHEN folder <> '' THEN concat(folder, '/') ELSE '' END, "
         f"'p', {co.PAGE_ID}, '.html') AS rel_path, html AS text FROM site)")

CONVERSATIONS = (f"turns AS (SELECT {co.CONV_PROJECT} AS project_id, {co.CONV_PATH} AS rel_path, text "
                 "FROM conversations)")


def _rule_text() -> str:
    cases = []
    for kind, lines in co.RULE_LINES.items():
        end = "chr(13), chr(10)" if co.RULE_BREAK.get(kind) else "chr(10)"
        parts = ", ".join(f"'{line}', {end}" for line in lines)
        cases.append(f"WHEN '{kind}' THEN concat({parts})")
    return "CASE rule_kind " + " ".join(cases) + " END"


_CYRILLIC = (f"translate(regexp_replace(text, '[^ -~\\n{co.ACCENTED}]', '?', 'g'), '{co.ACCENTED}', '{co.CYRILLIC}')")
_LATIN = "regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')"
_WIDE = "length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"
_BAD = "'" + c.REASON_BAD_BOM + "'"
# what the bytes of every kind must decode to
DECODED = (f"ruled AS (SELECT *, {_rule_text()} AS rule_text FROM docs), "
           "decoded AS (SELECT project_id, rel_path, base, doc_id, rule_kind, "
           f"CASE WHEN rule_kind IS NOT NULL THEN rule_text WHEN byte_kind IN (1, 7) THEN NULL "
           f"WHEN byte_kind = 2 THEN concat({_CYRILLIC}, chr(1055)) WHEN byte_kind = 3 THEN concat({_LATIN}, chr(152)) "
           "WHEN byte_kind = 4 THEN concat(repeat('x', 9000), chr(0), text) ELSE text END AS text, "
           "CASE WHEN rule_kind = 'G2' THEN 'utf-8-sig' WHEN rule_kind IS NOT NULL THEN 'utf-8' "
           "WHEN byte_kind = 0 THEN 'utf-8-sig' WHEN byte_kind IN (1, 7) THEN NULL "
           "WHEN byte_kind = 2 THEN 'cp1251' WHEN byte_kind = 3 THEN 'latin-1' WHEN byte_kind IN (5, 8) THEN 'utf-16' "
           "WHEN byte_kind = 6 THEN 'utf-32' ELSE 'utf-8' END AS encoding, "
           f"CASE WHEN rule_kind IS NOT NULL THEN NULL WHEN byte_kind = 1 THEN '{c.REASON_BINARY}' "
           f"WHEN byte_kind = 7 THEN {_BAD} END AS decode_reason, "
           "CASE WHEN rule_kind = 'G2' THEN strlen(rule_text) + 3 WHEN rule_kind IS NOT NULL THEN strlen(rule_text) "
           "WHEN byte_kind = 0 THEN strlen(text) + 3 WHEN byte_kind = 1 THEN strlen(text) + 1 "
           "WHEN byte_kind IN (2, 3) THEN length(text) + 1 WHEN byte_kind = 4 THEN 9001 + strlen(text) "
           f"WHEN byte_kind IN (5, 8) THEN 2 + 2 * (length(text) + {_WIDE}) "
           f"WHEN byte_kind = 7 THEN 3 + 2 * (length(text) + {_WIDE}) "
           "WHEN byte_kind = 6 THEN 4 + 4 * length(text) ELSE strlen(text) END AS size_bytes FROM ruled)")


# ---- paths

def parts(path: str) -> str:
    return f"string_split({path}, '/')"


def name(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def parent(path: str) -> str:
    return f"array_to_string(list_slice({parts(path)}, 1, len({parts(path)}) - 1), '/')"


def suffix(path: str) -> str:
    return f"lower(regexp_extract({name(path)}, '^.+([.][^.]+)$', 1))"


def above(path: str, own: bool = False) -> str:
    """List of the directories above a path without the root, with `own` itself too."""
    end = f"len({parts(path)})" + (" + 1" if own else "")
    return (f"list_transform(range(1, {end}), "
            f"lambda n: array_to_string(list_slice({parts(path)}, 1, n), '/'))")


def key(path: str, is_dir: str) -> str:
    return (f"list_transform({parts(path)}, lambda x, i: {{'f': CASE WHEN i = len({parts(path)}) "
            f"AND NOT ({is_dir}) THEN 1 ELSE 0 END, 'l': lower(x), 'n': x}})")


_NAMES = _list(n for n in c.IGNORED_NAMES if n == n.lower())
_ALLOWED = _list(c.ALLOWED_HIDDEN_FILES)


def builtin(path: str, is_file: str) -> str:
    own = f"CASE WHEN {is_file} THEN list_slice({parts(path)}, 1, len({parts(path)}) - 1) ELSE {parts(path)} END"
    return (f"CASE WHEN len(list_filter({own}, lambda p: lower(p) IN ({_NAMES}))) > 0 THEN 'ignored_name' "
            f"WHEN len(list_filter({parts(path)}, lambda p: ends_with(lower(p), '.egg-info'))) > 0 THEN 'egg_info' "
            f"WHEN len(list_filter({parts(path)}, lambda p: starts_with(p, '.') AND lower(p) NOT IN ({_ALLOWED}))) > 0 "
            f"THEN 'hidden' WHEN {is_file} AND {suffix(path)} IN ({_list(c.IGNORED_EXTENSIONS)}) "
            f"THEN 'binary_extension' WHEN {is_file} AND lower({name(path)}) IN ('desktop.ini', '.env') "
            "THEN 'junk_name' END")


LEFTOVER = f"CASE WHEN rel_path = '{c.LEFTOVER_NAME}' THEN 'leftover' END"
REASONED = (f"reasoned AS (SELECT project_id, rel_path, coalesce({builtin('rel_path', 'TRUE')}, {LEFTOVER}) "
            "AS reason FROM docs)")

# hand-written twins of the globs; '*' and '?' cross '/' in the whole path, not in a name
_GLOB_HITS = ("regexp_matches(rel_path, '^docs/.*$') OR regexp_matches(rel_path, '[.]toml(/|$)') "
              "OR regexp_matches(rel_path, '^B_.*[0-4][.]md(/|$)') OR regexp_matches(rel_path, '(^|/)B_[^/]*[0-4][.]md(/|$)') "
              "OR regexp_matches(rel_path, '^._1.*[.]txt(/|$)') OR regexp_matches(rel_path, '(^|/)[^/]_1[^/]*[.]txt(/|$)') "
              "OR regexp_matches(rel_path, '^[^a-h]un_') OR regexp_matches(rel_path, '(^|/)[^/a-h]un_') "
              "OR starts_with(rel_path, 'src/a_')")
_DIR_HITS = ("starts_with(rel_path, 'data/') OR starts_with(rel_path, 'docs/deep/') OR starts_with(rel_path, 'Pkg/') "
             "OR list_contains(string_split(rel_path, '/'), 'src')")
_PAGE_HITS = (f"list_contains({parts('rel_path')}, 'en') "
              f"OR len(list_filter({parts('rel_path')}, lambda p: regexp_matches(p, '^d.$'))) > 0 "
              "OR regexp_matches(rel_path, '^fr/[0-4]')")
# the two globs of the whole-pipeline queries
_PACK_HITS = "(starts_with({0}, 'src/a_') OR starts_with({0}, 'data/') OR {0} = 'data')"


def human(size: str) -> str:
    return (f"CASE WHEN {size} < 1024 THEN concat(CAST({size} AS VARCHAR), ' B') "
            f"WHEN {size} < 1048576 THEN concat(format('{{:.1f}}', {size} / 1024), ' KB') "
            f"ELSE concat(format('{{:.2f}}', {size} / 1048576), ' MB') END")


# ---- ignore rules: kind, line number, line, ignores, directories only, regex at the root, in a directory
_RULES = [
    ("G0", 2, "*.log", True, False, "^(.*/)?[^/]*[.]log(/.*)?$", "/[^/]*[.]log(/.*)?$"),
    ("G0", 3, "!e_*4.log", False, False, "^(.*/)?e_[^/]*4[.]log(/.*)?$", "/e_[^/]*4[.]log(/.*)?$"),
    ("G0", 4, "/Run_*", True, False, "^Run_[^/]*(/.*)?$", "/Run_[^/]*(/.*)?$"),
    ("G1", 1, "data/", True, True, "^(.*/)?data/.*$", "/data/.*$"),
    ("G1", 2, "*.txt", True, False, "^(.*/)?[^/]*[.]txt(/.*)?$", "/[^/]*[.]txt(/.*)?$"),
    ("G1", 4, "!c_*2.txt", False, False, "^(.*/)?c_[^/]*2[.]txt(/.*)?$", "/c_[^/]*2[.]txt(/.*)?$"),
    ("G2", 1, "**/deep/**", True, False, "^(.*/)?deep/.*$", "/(.*/)?deep/.*$"),
    ("G2", 2, "B_*[0-4].md", True, False, "^(.*/)?B_[^/]*[0-4][.]md(/.*)?$", "/B_[^/]*[0-4][.]md(/.*)?$"),
    ("G2", 3, "*.toml", True, False, "^(.*/)?[^/]*[.]toml(/.*)?$", "/[^/]*[.]toml(/.*)?$"),
    ("G2", 4, "!/i_*.toml", False, False, "^i_[^/]*[.]toml(/.*)?$", "/i_[^/]*[.]toml(/.*)?$"),
    ("T1", 1, "*.json", True, False, "^(.*/)?[^/]*[.]json(/.*)?$", "/[^/]*[.]json(/.*)?$"),
    ("T1", 2, "!f_*6.json", False, False, "^(.*/)?f_[^/]*6[.]json(/.*)?$", "/f_[^/]*6[.]json(/.*)?$"),
    ("T1", 3, "src", True, False, "^(.*/)?src(/.*)?$", "/src(/.*)?$"),
    ("T2", 1, "docs/*", True, False, "^docs/[^/]+(/.*)?$", "/docs/[^/]+(/.*)?$"),
    ("T2", 2, "!docs/deep", False, False, "^docs/deep(/.*)?$", "/docs/deep(/.*)?$"),
    ("T2", 3, "__init__*[!3].SQL", True, False, "^(.*/)?__init__[^/]*[^3][.]SQL(/.*)?$",
     "/__init__[^/]*[^3][.]SQL(/.*)?$"),
    ("T2", 4, "Pkg/**/[a-e]_*", True, False, "^Pkg/(.*/)?[a-e]_[^/]*(/.*)?$", "/Pkg/(.*/)?[a-e]_[^/]*(/.*)?$"),
]
_RULE_VALUES = ", ".join(
    f"('{k}', {n}, '{line}', {i}, {d}, '{root}', '{nested}')" for k, n, line, i, d, root, nested in _RULES)
RULE_FILES = (f"rule_files AS (SELECT project_id, {parent('rel_path')} AS dir, {name('rel_path')} AS name, rule_kind "
              f"FROM docs WHERE rule_kind IS NOT NULL AND coalesce({builtin('rel_path', 'TRUE')}, 'hidden') "
              "NOT IN ('ignored_name', 'egg_info'))")
RULES = (f"rule_lines(kind, line_no, raw, ignore, dir_only, root_re, nested_re) AS (VALUES {_RULE_VALUES}), "
         f"rules AS (SELECT project_id, dir, CASE WHEN dir = '' THEN 0 ELSE len({parts('dir')}) END AS depth, "
         f"name = '{c.TOOL_IGNORE_FILE}' AS is_tool, line_no, ignore, dir_only, "
         "CASE WHEN dir = '' THEN raw ELSE concat(CASE WHEN ignore THEN '' ELSE '!' END, dir, '/', "
         "ltrim(ltrim(raw, '!'), '/')) END AS line, "
         "CASE WHEN dir = '' THEN root_re ELSE concat('^', dir, nested_re) END AS regex "
         "FROM rule_files JOIN rule_lines ON kind = rule_kind)")


def verdicts(subjects: str, out: str) -> str:
    """CTEs giving for the paths of `subjects`(project_id, path, is_dir) whether rules ignore
    them or a directory above."""
    return (f"{out}_tests AS (SELECT DISTINCT project_id, path, unnest(list_concat(CASE WHEN is_dir THEN [path, concat(path, '/')] "
            f"ELSE [path] END, list_concat({above('path')}, list_transform({above('path')}, lambda a: concat(a, '/'))))) AS test "
            f"FROM {subjects}), "
            f"{out}_hits AS (SELECT t.project_id, path, test, last(ignore ORDER BY depth, is_tool, dir, line_no) AS ignored "
            f"FROM {out}_tests t JOIN rules r ON t.project_id = r.project_id AND regexp_matches(test, regex) "
            "GROUP BY ALL), "
            f"{out} AS (SELECT project_id, path, bool_or(ignored) AS ignored FROM {out}_hits GROUP BY ALL)")


# ---- documents

def document(kept: str, dirs: str, fmt: str, tree: bool = True, tokens: bool = True) -> str:
    """CTEs from `kept`(project_id, rel_path, text, skip_reason) and `dirs`(project_id, path),
    the visible directories, to `final`(project_id, doc, ...) and `doc_rows`."""
    text = fmt == "text"
    if text:
        block = ("concat('--- START OF FILE: ', rel_path, ' ---', chr(10), text, chr(10), "
                 "'--- END OF FILE: ', rel_path, ' ---')")
    else:
        block = (f"concat('### `', rel_path, '`', chr(10), {fence('text')}, {language('rel_path')}, chr(10), text, "
                 f"CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END, {fence('text')})")
    stats = ("list_filter([concat('{label}', split_part(project_id, '/', -1)), 'Generated on: " + STAMP + "', "
             "concat('Total files packed: ', CAST(packed AS VARCHAR)), CASE WHEN skipped > 0 THEN "
             "concat('Skipped files: ', CAST(skipped AS VARCHAR), ' (marked in the tree / see warnings)') END, "
             "concat('Total lines: ', CAST({lines} AS VARCHAR)), "
             "concat('Estimated tokens: ~', CAST({tokens} AS VARCHAR), ' ({method})')], lambda s: s IS NOT NULL)")
    ruler = "repeat('=', 80)"

    def header(lines, toks, method):
        rows = stats.format(label="PROJECT CONTEXT PACK: " if text else "Project: ", lines=lines, tokens=toks,
                            method=method)
        if text:
            return f"concat({ruler}, chr(10), array_to_string({rows}, chr(10)), chr(10), {ruler}, chr(10))"
        return f"concat('# Project Context Pack', chr(10), '- ', array_to_string({rows}, concat(chr(10), '- ')))"

    def assemble(head):
        if text:
            section = (f"concat({ruler}, chr(10), 'DIRECTORY TREE', chr(10), {ruler}, chr(10), tree, chr(10), chr(10))"
                       if tree else "''")
            return (f"concat({head}, chr(10), {section}, {ruler}, chr(10), 'FILES CONTENT', chr(10), {ruler}, chr(10), "
                    "chr(10), blocks, chr(10))")
        section = (f"concat('## Directory Tree', chr(10), chr(10), {fence('tree')}, 'text', chr(10), tree, chr(10), "
                   f"{fence('tree')}, chr(10), chr(10))" if tree else "''")
        return (f"concat({head}, chr(10), chr(10), {section}, '## Files Content', chr(10), chr(10), blocks, chr(10))")

    count = "length({0}) - length(replace({0}, chr(10), ''))".format
    source_lines = (f"CASE WHEN text = '' THEN 0 ELSE {count('text')} + "
                    "CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END")
    label = (f"concat({name('rel_path')}, CASE WHEN skip_reason IS NULL THEN '' "
             "ELSE concat('  [skipped: ', skip_reason, ']') END)")
    final_header = header("total_lines", "tokens", c.METHOD_HEURISTIC)
    ctes = [
        f"nodes AS (SELECT project_id, rel_path AS path, {label} AS label, {key('rel_path', 'FALSE')} AS k, FALSE AS is_dir "
        f"FROM {kept} UNION ALL SELECT project_id, path, concat({name('path')}, '/'), {key('path', 'TRUE')}, TRUE FROM {dirs})",
        tree_ctes(),
        f"packed AS (SELECT project_id, {key('rel_path', 'FALSE')} AS k, {block} AS block, {source_lines} AS source_lines "
        f"FROM {kept} WHERE skip_reason IS NULL)",
        f"counts AS (SELECT project_id, count(*) FILTER (WHERE skip_reason IS NULL) AS packed, "
        f"count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped FROM {kept} GROUP BY ALL)",
        "bodies AS (SELECT project_id, string_agg(block, concat(chr(10), chr(10)) ORDER BY k) AS blocks, "
        "CAST(sum(source_lines) AS BIGINT) AS source_lines FROM packed GROUP BY ALL)",
        "trees AS (SELECT project_id, string_agg(line, chr(10) ORDER BY k) AS tree FROM lines GROUP BY ALL)",
        "base AS (SELECT p.project_id, coalesce(packed, 0) AS packed, coalesce(skipped, 0) AS skipped, "
        "coalesce(blocks, '') AS blocks, coalesce(source_lines, 0) AS source_lines, tree FROM projects p "
        "LEFT JOIN counts USING (project_id) LEFT JOIN bodies USING (project_id) LEFT JOIN trees USING (project_id))",
        f"drafts AS (SELECT *, {assemble(header('0', '0', ''))} AS draft FROM base)",
        f"counted AS (SELECT *, {count('draft')} AS total_lines, "
        "CAST(floor(length(draft) / 4 + 0.5) AS BIGINT) AS tokens FROM drafts)",
        f"final AS (SELECT *, {final_header} AS header, {assemble(final_header)} AS doc FROM counted)",
    ]
    opening = (f"concat({ruler}, chr(10), 'FILES CONTENT', chr(10), {ruler})" if text else "'## Files Content'")
    rows = ["SELECT project_id, 0 AS section, [] AS k, "
            + ("header" if text else "concat(header, chr(10))") + " AS text FROM final",
            f"SELECT project_id, 4, [], concat({opening}, CASE WHEN packed = 0 THEN concat(chr(10), chr(10)) ELSE '' END) "
            "FROM final",
            "SELECT project_id, 5, k, concat(chr(10), block) FROM packed"]
    if tree:
        if text:
            start, end = f"concat({ruler}, chr(10), 'DIRECTORY TREE', chr(10), {ruler})", "''"
        else:
            start = f"concat('## Directory Tree', chr(10), chr(10), {fence('tree')}, 'text')"
            end = f"concat({fence('tree')}, chr(10))"
        rows += [f"SELECT project_id, 1, [], {start} FROM final", f"SELECT project_id, 3, [], {end} FROM final",
                 "SELECT project_id, 2, k, line FROM lines"]
    ctes.append("doc_rows AS (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(ctes)


def fence(text: str) -> str:
    return f"repeat('`', greatest(3, 1 + {longest_run(text)}))"


def longest_run(text: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({text}, '`+'), lambda r: length(r))), 0)"


def language(path: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in c.LANGUAGES.items())
    return f"CASE {suffix(path)} {cases} ELSE '' END"


def tree_ctes(extra: str = "") -> str:
    """CTEs from nodes(project_id, path, label, k, is_dir) to lines(project_id, k, line)."""
    return (f"placed AS (SELECT *, row_number() OVER (PARTITION BY project_id, {parent('path')} ORDER BY k DESC) = 1 "
            "AS is_last FROM nodes), "
            f"steps AS (SELECT project_id, path, unnest({above('path')}) AS dir FROM nodes), "
            "indents AS (SELECT s.project_id, s.path, string_agg(CASE WHEN d.is_last THEN '    ' ELSE '│   ' END, '' "
            "ORDER BY length(s.dir)) AS indent FROM steps s JOIN placed d ON d.project_id = s.project_id "
            "AND d.path = s.dir AND d.is_dir GROUP BY ALL), "
            "lines AS (SELECT project_id, [] AS k, concat(split_part(project_id, '/', -1), '/') AS line FROM projects "
            "UNION ALL SELECT n.project_id, n.k, concat(coalesce(indent, ''), CASE WHEN is_last THEN '└── ' ELSE '├── ' END, "
            f"label) FROM placed n LEFT JOIN indents i ON i.project_id = n.project_id AND i.path = n.path{extra})")


def _dirs(files: str, out: str = "dirs", where: str = "TRUE") -> str:
    return (f"{out} AS (SELECT DISTINCT project_id, path FROM (SELECT project_id, unnest({above('rel_path')}) AS path "
            f"FROM {files}) t WHERE {where})")


NUMBERED_LINES = "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY k) AS line_no, line FROM lines"
NUMBERED_ROWS = ("SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY section, k) AS position, text "
                 "FROM doc_rows")


def _report(fmt: str, tree: bool = True) -> str:
    return (f"SELECT project_id, split_part(project_id, '/', -1) AS project_name, packed AS packed_count, "
            f"skipped AS failed_count, strlen(doc) AS file_size, total_lines, source_lines AS total_source_lines, "
            f"tokens AS estimated_tokens, '{c.METHOD_HEURISTIC}' AS token_method, '{fmt}' AS output_format, "
            f"{tree} AS include_tree FROM final")


# documents through all layers; `globs` tells whether the two globs of the pipeline apply
def _kept_documents(globs: bool, limit: int | None) -> list[str]:
    hit = (lambda p: _PACK_HITS.format(p)) if globs else (lambda p: "FALSE")
    size = (f"CASE WHEN size_bytes > {limit} THEN concat('exceeds size limit (', {human(str(limit))}, ')') END"
            if limit else "CAST(NULL AS VARCHAR)")
    return [
        DOCS, DECODED, RULE_FILES, RULES,
        "projects AS (SELECT DISTINCT project_id FROM docs)",
        _dirs("docs", "all_dirs"),
        "subjects AS (SELECT project_id, rel_path AS path, FALSE AS is_dir FROM docs UNION ALL "
        "SELECT project_id, path, TRUE FROM all_dirs)",
        verdicts("subjects", "verdict"),
        f"kept AS (SELECT d.project_id, rel_path, text, coalesce({size}, decode_reason) AS skip_reason FROM decoded d "
        "LEFT JOIN verdict v ON v.project_id = d.project_id AND v.path = d.rel_path "
        f"WHERE coalesce({builtin('rel_path', 'TRUE')}, {LEFTOVER}) IS NULL AND NOT {hit('rel_path')} "
        "AND NOT coalesce(ignored, FALSE))",
        "dirs AS (SELECT d.project_id, d.path FROM all_dirs d LEFT JOIN verdict v ON v.project_id = d.project_id "
        f"AND v.path = d.path WHERE {builtin('d.path', 'FALSE')} IS NULL AND NOT {hit('d.path')} "
        "AND NOT coalesce(ignored, FALSE))",
    ]


def _plain(corpus: str, table: str, where: str = "TRUE", dir_where: str = "TRUE") -> list[str]:
    return [corpus, f"projects AS (SELECT DISTINCT project_id FROM {table})",
            f"kept AS (SELECT project_id, rel_path, text, CAST(NULL AS VARCHAR) AS skip_reason FROM {table} WHERE {where})",
            _dirs(table, "dirs", dir_where)]


# ---- links: hand-resolved, since a chain has at most one more link
_UNDER = "regexp_replace(base, '/$', '')"
LINKS = (
    f"all_links AS (SELECT {co.DOC_PROJECT} AS project_id, {co.DOC_BASE} AS base, doc_id, {co.DOC_PATH} AS doc_path, "
    f"{co.LINK_NAME} AS rel_path, {co.LINK_KIND} AS kind, {co.LINK_TARGET} AS link_target FROM documents WHERE doc_id % 3 = 0), "
    + _dirs("docs", "doc_dirs") + ", "
    "all_dirs AS (SELECT project_id, path FROM doc_dirs UNION SELECT project_id, concat(base, 'links') FROM all_links), "
    # the link itself, or the one it names
    "hopped AS (SELECT l.project_id, l.rel_path, l.base, l.link_target, l.doc_id, coalesce(n.kind, l.kind) AS kind, "
    "CASE WHEN l.kind IN (4, 5) THEN n.doc_path ELSE l.doc_path END AS doc_path, l.kind IN (4, 5) AND n.kind IS NULL AS lost "
    "FROM all_links l LEFT JOIN all_links n ON l.kind IN (4, 5) AND n.project_id = l.project_id "
    "AND n.rel_path = concat(l.base, 'links/l_', CAST(l.doc_id - 60 AS VARCHAR))), "
    "resolved AS (SELECT project_id, rel_path, base, link_target, CASE WHEN lost THEN concat(base, 'links/l_', CAST(doc_id - 60 AS VARCHAR)) "
    "WHEN kind = 0 THEN doc_path WHEN kind IN (1, 2) THEN NULL WHEN kind = 3 THEN concat(base, 'src') "
    f"WHEN kind = 6 THEN concat(base, 'data') ELSE {_UNDER} END AS place, kind, lost FROM hopped), "
    "links AS (SELECT r.*, CASE WHEN NOT lost AND kind = 0 THEN 'file' WHEN place = '' THEN 'dir' "
    "WHEN d.path IS NOT NULL THEN 'dir' END AS target_kind "
    "FROM resolved r LEFT JOIN all_dirs d ON d.project_id = r.project_id AND d.path = r.place)")
# the directory ids: data and src of one directory are the same, data comes first
REPEATS = (f"repeats AS (SELECT a.project_id, a.path FROM all_dirs a JOIN all_dirs b ON a.project_id = b.project_id "
           f"AND {name('a.path')} = 'src' AND {name('b.path')} = 'data' AND {parent('a.path')} = {parent('b.path')})")
_BELOW = ("EXISTS (SELECT 1 FROM repeats r WHERE r.project_id = {0}.project_id "
          "AND starts_with({0}.{1}, concat(r.path, '/')))")
IS_FILE = "(target_kind IS NOT NULL AND target_kind = 'file')"
# directories count where the link leads, extension and name are the link's own
_BY_PLACE, _BY_NAME = builtin("place", IS_FILE), builtin("rel_path", IS_FILE)
FATES = (
    "fates AS (SELECT project_id, rel_path, 'file' AS kind, CAST(NULL AS VARCHAR) AS link_target, "
    f"CAST(NULL AS VARCHAR) AS place, 'file' AS target_kind, coalesce(CASE WHEN {_BELOW.format('docs', 'rel_path')} "
    f"THEN 'repeated_directory' END, {builtin('rel_path', 'TRUE')}, {LEFTOVER}) AS reason FROM docs UNION ALL "
    f"SELECT project_id, rel_path, 'link', link_target, place, target_kind, CASE WHEN place IS NULL THEN 'outside_root' "
    f"ELSE coalesce(CASE WHEN {_BY_PLACE} IN ('ignored_name', 'egg_info', 'hidden') THEN {_BY_PLACE} END, "
    f"CASE WHEN {_BY_NAME} IN ('binary_extension', 'junk_name') THEN {_BY_NAME} END) END FROM links)")


def _oracles() -> dict[str, str]:
    docs = lambda select: _with(DOCS, select=select)
    number = "CAST(length(text) AS VARCHAR)"
    size_text = (f"CASE doc_id % 9 WHEN 0 THEN {number} WHEN 1 THEN concat({number}, 'B') WHEN 2 THEN concat('  ', {number}, ' kb ') "
                 f"WHEN 3 THEN concat({number}, '.5MB') WHEN 4 THEN concat({number}, 'GB') WHEN 5 THEN concat({number}, 'XB') "
                 f"WHEN 6 THEN '0.5B' WHEN 7 THEN concat('0.', {number}, 'Kb') ELSE concat('-', {number}) END")
    size_value = (f"CASE doc_id % 9 WHEN 0 THEN length(text) WHEN 1 THEN length(text) WHEN 2 THEN length(text) * 1024 "
                  f"WHEN 3 THEN length(text) * 1048576 + 524288 WHEN 4 THEN length(text) * 1073741824 "
                  f"WHEN 7 THEN CAST(floor(CAST(concat('0.', {number}) AS DOUBLE) * 1024) AS BIGINT) END")
    size = "strlen(text) * CAST(power(10, doc_id % 5) AS BIGINT)"
    count = "length(text) - length(replace(text, chr(10), ''))"
    lines = (f"CASE WHEN text = '' THEN 0 ELSE {count} + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END")
    turns = _plain(CONVERSATIONS, "turns")
    report_docs = _kept_documents(True, 9000)
    full_docs = _kept_documents(False, None)
    line_values = ", ".join(f"('{k}', {i}, '{line}')" for k, ls in co.RULE_LINES.items()
                            for i, line in enumerate(ls, 1))

    def pack(ctes, fmt, tree=True, select=NUMBERED_ROWS):
        return _with(*ctes, document("kept", "dirs", fmt, tree), select=select)

    out = {
        "ignore_reason_by_layer": _with(DOCS, REASONED, select="SELECT project_id, coalesce(reason, 'kept') AS layer, "
                                        "count(*) AS files FROM reasoned GROUP BY ALL"),
        "kept_files": _with(DOCS, REASONED, select="SELECT project_id, rel_path FROM reasoned WHERE reason IS NULL"),
        "path_parts_suffix": docs(f"SELECT project_id, rel_path, {name('rel_path')} AS name, {parent('rel_path')} AS parent, "
                                  f"{suffix('rel_path')} AS suffix, len({parts('rel_path')}) AS depth FROM docs"),
        "language_census": docs(f"SELECT project_id, {language('rel_path')} AS language, count(*) AS files FROM docs GROUP BY ALL"),
        "glob_exclude": docs(f"SELECT project_id, rel_path, ({_GLOB_HITS}) AS excluded FROM docs"),
        "dir_pattern_exclude": docs(f"SELECT project_id, rel_path, ({_DIR_HITS}) AS excluded FROM docs"),
        "ancestor_prune": _with(PAGES, select=f"SELECT project_id, rel_path FROM page_files WHERE NOT ({_PAGE_HITS})"),
        "size_cap": _with(DOCS, DECODED, select="SELECT project_id, rel_path, size_bytes, CASE WHEN size_bytes > 1024 THEN "
                          "'exceeds size limit (1.0 KB)' END AS skip_reason FROM decoded"),
        "human_bytes": f"SELECT doc_id, {size} AS size_bytes, {human('(' + size + ')')} AS size_text FROM documents",
        "parse_size": f"SELECT doc_id, {size_text} AS size_text, {size_value} AS size_bytes FROM documents",
        "ignore_files_found": _with(DOCS, RULE_FILES, select="SELECT project_id, dir, name FROM rule_files"),
        "ignore_file_lines": _with(DOCS, RULE_FILES, f"v(kind, line_no, line) AS (VALUES {line_values})",
                                   select="SELECT project_id, dir, name, CAST(line_no AS BIGINT) AS line_no, line "
                                   "FROM rule_files JOIN v ON kind = rule_kind"),
        "rules_rebased": _with(DOCS, RULE_FILES, RULES, select="SELECT project_id, dir, CAST(line_no AS BIGINT) AS line_no, "
                               "is_tool, line, ignore, dir_only FROM rules"),
        "rules_ordered": _with(DOCS, RULE_FILES, RULES, select="SELECT project_id, row_number() OVER (PARTITION BY project_id "
                               "ORDER BY depth, is_tool, dir, line_no) AS rule_no, line FROM rules"),
        "rules_last_match": _with(
            DOCS, RULE_FILES, RULES, "subjects AS (SELECT project_id, rel_path AS path, FALSE AS is_dir FROM docs)",
            verdicts("subjects", "verdict"),
            select="SELECT d.project_id, rel_path, coalesce(ignored, FALSE) AS rule_ignored FROM docs d LEFT JOIN verdict v "
            "ON v.project_id = d.project_id AND v.path = d.rel_path"),
        "all_layers": _with(
            DOCS, RULE_FILES, RULES, "subjects AS (SELECT project_id, rel_path AS path, FALSE AS is_dir FROM docs)",
            verdicts("subjects", "verdict"),
            # globs and rules on the directories above speak before a file's own layers
            _dirs("docs", "all_dirs"),
            "dir_subjects AS (SELECT project_id, path, TRUE AS is_dir FROM all_dirs)",
            verdicts("dir_subjects", "dir_verdict"),
            select="SELECT d.project_id, rel_path, coalesce(CASE WHEN starts_with(rel_path, 'data/') THEN 'user_glob' END, "
            f"CASE WHEN dv.ignored THEN 'ignore_file' END, {builtin('rel_path', 'TRUE')}, "
            f"CASE WHEN {_PACK_HITS.format('rel_path')} THEN 'user_glob' END, CASE WHEN v.ignored THEN 'ignore_file' END, "
            f"CASE WHEN rel_path = 'docs/dist' THEN 'output_file' END, {LEFTOVER}, 'kept') AS layer FROM docs d "
            "LEFT JOIN verdict v ON v.project_id = d.project_id AND v.path = d.rel_path "
            f"LEFT JOIN dir_verdict dv ON dv.project_id = d.project_id AND dv.path = {parent('d.rel_path')}"),
        "encoding_census": _with(DOCS, DECODED, select="SELECT coalesce(encoding, 'none') AS encoding, count(*) AS files "
                                 "FROM decoded GROUP BY ALL"),
        "decoded_text": _with(DOCS, DECODED, select="SELECT project_id, rel_path, md5(text) AS text_md5, length(text) AS chars FROM decoded"),
        "decode_utf16_utf32": _with(DOCS, DECODED, select="SELECT project_id, rel_path, encoding, text FROM decoded "
                                    "WHERE encoding IN ('utf-16', 'utf-32')"),
        "binary_sniff": docs("SELECT project_id, rel_path, rule_kind IS NULL AND (byte_kind = 1 OR byte_kind = 6 OR "
                             "(byte_kind IN (5, 7, 8) AND regexp_matches(substr(text, 1, 4095), '[\\x00-\\xFF]'))) AS has_nul FROM docs"),
        "skip_reasons": _with(DOCS, DECODED, select="SELECT project_id, rel_path, coalesce(CASE WHEN size_bytes > 9000 THEN "
                              "'exceeds size limit (8.8 KB)' END, decode_reason) AS skip_reason FROM decoded "
                              "WHERE size_bytes > 9000 OR decode_reason IS NOT NULL"),
        "transcoded_files": _with(DOCS, DECODED, select="SELECT project_id, rel_path, encoding FROM decoded "
                                  "WHERE encoding IN ('cp1251', 'latin-1', 'utf-16', 'utf-32')"),
        "streamed_facts": _with(
            DOCS, DECODED, f"layered AS (SELECT *, coalesce({builtin('rel_path', 'TRUE')}, CASE WHEN "
            f"{_PACK_HITS.format('rel_path')} THEN 'user_glob' END, {LEFTOVER}) AS ignore_reason FROM decoded)",
            "reasons AS (SELECT *, CASE WHEN ignore_reason IS NULL THEN coalesce(CASE WHEN size_bytes > 9000 THEN "
            "'exceeds size limit (8.8 KB)' END, decode_reason) END AS skip_reason FROM layered)",
            "shown AS (SELECT * EXCLUDE (text, encoding), CASE WHEN ignore_reason IS NULL AND skip_reason IS NULL THEN text "
            "END AS text, CASE WHEN ignore_reason IS NULL AND skip_reason IS NULL THEN encoding END AS encoding FROM reasons)",
            select=f"SELECT project_id, rel_path, {name('rel_path')} AS name, {parent('rel_path')} AS parent, "
            f"{suffix('rel_path')} AS suffix, len({parts('rel_path')}) AS depth, {language('rel_path')} AS language, "
            f"ignore_reason, size_bytes, skip_reason, encoding, CASE WHEN text IS NOT NULL THEN {lines} END AS lines, "
            "CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens, md5(text) AS text_md5 FROM shown"),
        "line_counts": _with(DOCS, TICKED, select=f"SELECT doc_id, {lines} AS lines FROM ticked"),
        "token_heuristic": "SELECT doc_id, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens FROM documents",
        "project_totals": _with(
            *full_docs, select=f"SELECT p.project_id, count(k.rel_path) FILTER (WHERE skip_reason IS NULL) AS packed_count, "
            f"count(k.rel_path) FILTER (WHERE skip_reason IS NOT NULL) AS failed_count, "
            f"CAST(coalesce(sum(CASE WHEN skip_reason IS NULL THEN {lines} END), 0) AS BIGINT) AS total_source_lines, "
            f"0 AS estimated_tokens, '{c.METHOD_OFF}' AS token_method "
            "FROM projects p LEFT JOIN kept k ON k.project_id = p.project_id GROUP BY p.project_id"),
        "content_order": _with(DOCS, REASONED, select="SELECT project_id, rel_path, row_number() OVER (PARTITION BY project_id "
                               f"ORDER BY {key('rel_path', 'FALSE')}) AS position FROM reasoned WHERE reason IS NULL"),
        "tree_order": _with(
            DOCS, _dirs("docs"), f"n AS (SELECT project_id, rel_path AS path, {key('rel_path', 'FALSE')} AS k FROM docs UNION ALL "
            f"SELECT project_id, path, {key('path', 'TRUE')} FROM dirs)",
            select="SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY k) AS position FROM n"),
        "last_sibling": _with(
            PAGES, _dirs("page_files"), f"n AS (SELECT project_id, rel_path AS path, {key('rel_path', 'FALSE')} AS k "
            f"FROM page_files UNION ALL SELECT project_id, path, {key('path', 'TRUE')} FROM dirs), "
            f"m AS (SELECT *, {parent('path')} AS dir FROM n)",
            select="SELECT project_id, dir, last(path ORDER BY k) AS last_child, count(*) AS children FROM m GROUP BY ALL"),
        "dir_inventory": _with(
            DOCS, _dirs("docs"), select="SELECT d.project_id, d.path AS dir, count(f.rel_path) AS entries FROM dirs d LEFT JOIN docs f "
            f"ON f.project_id = d.project_id AND {parent('f.rel_path')} = d.path GROUP BY ALL"),
        "tree_lines": _with(
            PAGES, "projects AS (SELECT DISTINCT project_id FROM page_files)", _dirs("page_files"),
            f"nodes AS (SELECT project_id, rel_path AS path, {name('rel_path')} AS label, {key('rel_path', 'FALSE')} AS k, "
            f"FALSE AS is_dir FROM page_files UNION ALL SELECT project_id, path, concat({name('path')}, '/'), "
            f"{key('path', 'TRUE')}, TRUE FROM dirs)", tree_ctes(), select=NUMBERED_LINES),
        "tree_with_skips": _with(*_kept_documents(False, 9000), document("kept", "dirs", "text"), select=NUMBERED_LINES),
        "link_containment": _with(DOCS, LINKS, select="SELECT project_id, rel_path, place AS resolved_rel_path, target_kind, "
                                  "place IS NULL AS outside_root FROM links"),
        "link_suffixes": _with(DOCS, LINKS, select=f"SELECT project_id, rel_path, {name('rel_path')} AS label FROM docs UNION ALL "
                               f"SELECT project_id, rel_path, concat({name('rel_path')}, ' -> ', link_target) FROM links"),
        "duplicate_dirs": _with(DOCS, LINKS, REPEATS, select="SELECT project_id, path AS dir FROM repeats "
                                f"WHERE {builtin('path', 'FALSE')} IS NULL"),
        "linked_entries": _with(
            DOCS, LINKS, REPEATS, FATES, select="SELECT project_id, rel_path, coalesce(reason, "
            "CASE WHEN target_kind = 'file' THEN 'packed' ELSE 'shown' END) AS fate FROM fates"),
        "output_self_exclusion": _with(
            DOCS, LINKS, REPEATS, FATES,
            select="SELECT project_id, rel_path, coalesce(reason, 'output_file') AS ignore_reason FROM fates "
            "WHERE reason = 'leftover' OR (reason IS NULL AND (coalesce(place, rel_path) = 'docs/deep' "
            "OR starts_with(coalesce(place, rel_path), 'docs/deep/')))"),
        "extra_filter_layer": _with(
            DOCS, _dirs("docs", "dirs", f"{builtin('path', 'FALSE')} IS NULL"),
            select=f"SELECT project_id, rel_path AS path, coalesce({builtin('rel_path', 'TRUE')}, "
            "CASE WHEN rel_path LIKE '%e_%' OR length(rel_path) % 5 = 4 THEN 'extra_filter' END, "
            f"{LEFTOVER}, 'kept') AS layer FROM docs UNION ALL SELECT project_id, path, 'directory' FROM dirs "
            "UNION ALL SELECT DISTINCT project_id, '', 'directory' FROM docs"),
        "fence_length": _with(DOCS, TICKED, select=f"SELECT doc_id, {longest_run('text')} AS longest_run, {fence('text')} AS fence FROM ticked"),
        "header_text": pack(full_docs, "text", select="SELECT project_id, header FROM final"),
        "header_markdown": pack(full_docs, "markdown", select="SELECT project_id, concat(header, chr(10)) AS header FROM final"),
        "document_measures": pack(full_docs, "markdown", False, "SELECT project_id, total_lines, tokens AS estimated_tokens, "
                                  "strlen(doc) AS file_size FROM final"),
        "pack_text": pack(turns, "text"),
        "pack_markdown": pack(turns, "markdown"),
        "pack_text_no_tree": pack(turns, "text", False),
        "pack_markdown_no_tree": pack(turns, "markdown", False),
        "pack_report": pack(report_docs, "text", select=_report("text")),
        "pages_site_pack": pack(_plain(PAGES, "page_files", f"NOT ({_PAGE_HITS})", f"NOT ({_PAGE_HITS.replace('rel_path', 'path')})"),
                                "markdown", select=_report("markdown")),
    }
    blocks = {
        "text_blocks": "concat('--- START OF FILE: ', rel_path, ' ---', chr(10), text, chr(10), '--- END OF FILE: ', rel_path, ' ---')",
        "markdown_blocks": f"concat('### `', rel_path, '`', chr(10), {fence('text')}, {language('rel_path')}, chr(10), text, "
                           f"CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END, {fence('text')})"}
    for block_name, block in blocks.items():
        out[block_name] = _with(DOCS, TICKED, select=f"SELECT doc_id, md5({block}) AS block_md5, length({block}) AS chars FROM ticked")
    # links are shown with their notes; a directory link was met before if its target comes first
    target_id = "coalesce(CASE WHEN {1} IN ('data', 'src') THEN concat('twin:', {2}) END, {0})"
    out["tree_links"] = _with(
        DOCS, LINKS, REPEATS, FATES, "projects AS (SELECT DISTINCT project_id FROM docs)",
        f"seen_dirs AS (SELECT project_id, path FROM all_dirs d WHERE {builtin('path', 'FALSE')} IS NULL "
        f"AND NOT {_BELOW.format('d', 'path')})",
        f"visits AS (SELECT project_id, {target_id.format('path', name('path'), parent('path'))} AS id, min({key('path', 'TRUE')}) AS k "
        "FROM seen_dirs GROUP BY ALL)",
        "noted AS (SELECT f.project_id, f.rel_path, f.kind, f.link_target, f.reason, f.target_kind, "
        f"f.place = '' OR v.k < {key('f.rel_path', 'FALSE')} AS met FROM fates f LEFT JOIN visits v ON v.project_id = f.project_id "
        f"AND f.kind = 'link' AND v.id = {target_id.format('f.place', name('f.place'), parent('f.place'))} "
        "WHERE reason IS NULL OR reason = 'outside_root')",
        f"nodes AS (SELECT project_id, rel_path AS path, concat({name('rel_path')}, "
        "CASE WHEN kind = 'link' THEN concat(' -> ', link_target) ELSE '' END, "
        f"CASE WHEN reason IS NOT NULL THEN '  [{c.NOTE_OUTSIDE}]' WHEN kind = 'link' AND target_kind = 'dir' THEN "
        f"CASE WHEN met THEN '  [{c.NOTE_REPEATED}]' ELSE '  [{c.NOTE_DIR_LINK}]' END ELSE '' END) AS label, "
        f"{key('rel_path', 'FALSE')} AS k, FALSE AS is_dir FROM noted UNION ALL "
        f"SELECT project_id, path, concat({name('path')}, '/'), {key('path', 'TRUE')}, TRUE FROM seen_dirs)",
        tree_ctes(" UNION ALL SELECT d.project_id, list_append("
                  + key("d.path", "TRUE") + ", {'f': 0, 'l': '', 'n': ''}), concat(coalesce(indent, ''), "
                  f"CASE WHEN is_last THEN '    ' ELSE '│   ' END, '└── [{c.NOTE_REPEATED}]') FROM repeats d "
                  "JOIN placed n ON n.project_id = d.project_id AND n.path = d.path AND n.is_dir "
                  "LEFT JOIN indents i ON i.project_id = d.project_id AND i.path = d.path"),
        select=NUMBERED_LINES)
    return out


ORACLES = _oracles()
