"""The well-known public graph of six people and programs, as text files and as plain Python values."""

from pathlib import Path

PEOPLE = {1: ("marko", 29), 2: ("vadas", 27), 4: ("josh", 32), 6: ("peter", 35)}
PROGRAMS = {3: ("lop", "java"), 5: ("ripple", "java")}
#: source, destination, label, weight
EDGES = [(1, 2, "knows", 0.5), (1, 3, "created", 0.4), (1, 4, "knows", 1.0), (4, 5, "created", 1.0), (4, 3, "created", 0.4), (6, 3, "created", 0.2)]

VERTICES = {k: {"label": "person", "name": n, "age": a} for k, (n, a) in PEOPLE.items()} | {k: {"label": "software", "name": n, "lang": x} for k, (n, x) in PROGRAMS.items()}


def write_files(folder) -> str:
    near = lambda v, a, b: [e[b] for e in EDGES if e[a] == v]
    files = {
        "index/vtx_label": "person\t1\nsoftware\t2\n",
        "index/edge_label": "knows\t1\ncreated\t2\n",
        "index/vtx_property_index": "name\t1\t4\nage\t2\t1\nlang\t3\t4\n",
        "index/edge_property_index": "weight\t1\t2\n",
        "vertices/part_1": "".join(f"{v}\t{len(i := near(v, 1, 0))}\t{''.join(f'{x} ' for x in i)}{len(o := near(v, 0, 1))}\t{' '.join(map(str, o))}\n" for v in sorted(VERTICES)),
        "vtx_property/part_1": "\n".join([f'{k}\t1\t[1:"{n}",2:{a}]' for k, (n, a) in PEOPLE.items()] + [f'{k}\t2\t[1:"{n}",3:"{x}"]' for k, (n, x) in PROGRAMS.items()]),
        "edge_property/part_1": "\n".join(f"{s}\t{d}\t{1 if n == 'knows' else 2}\t[1:{w}]" for s, d, n, w in EDGES),
    }
    for name, text in files.items():
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)
