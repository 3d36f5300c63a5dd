"""A project of a few files, some of which are always ignored."""

SAMPLE = {
    ".svn/entries": "12\n", "node_modules/pad/index.js": "module.exports = 1\n", "media/intro.mp4": b"\0\0\0\x18ftyp",
    ".env": "PIN=walrus\n", ".gitignore": "*.bak\n", "web/app.ts": "let n = 1\nexport default n\n", "web/empty.ts": "",
    "notes/plan.md": "# Plan\n", "Dockerfile": "FROM scratch\n", "zeta.rs": "fn main() {}\n",
    "pipeline.yaml": "steps: []\n",
}
