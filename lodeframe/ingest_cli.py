"""python -m lodeframe.ingest_cli [--port N] [FILE or FOLDER ...]: post files, or standard input, to a running server."""

import argparse
import sys
import urllib.parse
import urllib.request
from pathlib import Path


def post(port: int, name: str, raw: bytes) -> str:
    url = f"http://127.0.0.1:{port}/upload/auto?name={urllib.parse.quote(name)}"
    with urllib.request.urlopen(urllib.request.Request(url, data=raw, method="POST")) as r:  # noqa: S310
        return r.read().decode()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--port", type=int, default=8822)
    p.add_argument("paths", nargs="*")
    got = p.parse_args(args)
    if not got.paths:
        print(post(got.port, "standard_input_data", sys.stdin.buffer.read()))
    for path in map(Path, got.paths):
        for f in sorted(path.iterdir()) if path.is_dir() else [path]:
            print(post(got.port, f.stem, f.read_bytes()))


if __name__ == "__main__":
    main()
