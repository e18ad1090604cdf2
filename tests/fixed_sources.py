"""A small repository written by hand, with what the rules find in it."""

_BODY = "\n".join(f"    total += values[{i}] * {i}" for i in range(60))
SOURCES = {
    "src/app/alpha.py": "from app.beta import run_beta\n\n__all__ = ['start']\n\n\ndef start(values):\n    return run_beta(values)\n",
    "src/app/beta.py": "from . import gamma\n\n\ndef run_beta(values):\n    return gamma.run_gamma(values)\n",
    "src/app/gamma.py": "import app.alpha\n\n\ndef run_gamma(values):\n    return len(values)\n\n\ndef unused_helper():\n    return 'constant text here'\n",
    "src/app/large.py": f"def load_all(values):\n    total = 0\n{_BODY}\n    return total\n\n\ndef save_all(x):\n    return x\n\n\ndef parse_all(x):\n    # TODO one\n    # FIXME two\n    # HACK three\n    return ['repeated literal', 'repeated literal', 'repeated literal', 'repeated literal']\n",
    "src/app/shapes.py": "def first(items):\n    found = []\n    for item in items:\n        if item > 1:\n            found.append(item * 2)\n    return found\n\n\ndef second(rows):\n    result = []\n    for row in rows:\n        if row > 1:\n            result.append(row * 2)\n    return result\n\n\nclass Box:\n    def __init__(self, size: int):\n        self.size = size\n\n    async def open(self):\n        if self.size:\n            for a in range(3):\n                while a:\n                    with self.size:\n                        try:\n                            a -= 1\n                        finally:\n                            pass\n",
    "src/app/mixed.py": "def load_rows(path):\n    return path\n\n\ndef save_rows(rows):\n    return rows\n\n\ndef render_rows(rows):\n    return rows\n" + "\n" * 300,
    "src/app/broken.py": "def broken(:\n    pass\n",
    "tests/test_alpha.py": "from unittest import mock\n\n\ndef test_nothing():\n    pass\n\n\ndef test_runs():\n    run_beta([1])\n\n\ndef test_true():\n    assert True\n\n\n@mock.patch('a')\n@mock.patch('b')\ndef test_mocked(a, b):\n    m = mock.Mock()\n    n = mock.MagicMock()\n    m(n)\n\n\ndef test_real():\n    assert 1 + 1 == 2\n",
    "web/Panel.tsx": "import React from 'react';\nexport type PanelProps = {\n" + "".join(f"  readonly p{i}: string;\n" for i in range(9)) + "};\nexport function Panel(props: PanelProps) {\n" + "".join(f"  const s{i} = useState({i});\n" for i in range(9)) + "  return <div className=\"panel-main\" id=\"panel-main\">x</div>;\n}\n",
    "web/route.ts": "export async function GET(request) {\n" + "".join(f"  const v{i} = request.v{i};\n" for i in range(45)) + "  return v1;\n}\n// TODO a\n// TODO b\n",
    "web/route.test.ts": "it('does nothing', () => {\n  run();\n});\nit.skip('later', () => {\n  expect(true).toBe(true);\n});\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\tos "os"\n)\n\ntype Server struct {\n\tname string\n}\n\nfunc (s *Server) Run() {\n\tfmt.Println("listening on port", "listening on port")\n\tfmt.Println("listening on port", "listening on port")\n}\n\nfunc Serve() {\n' + "\tfmt.Println(1)\n" * 55 + "}\n",
    "lib/widget.rb": "# TODO x\n# TODO y\n# FIXME z  # quern: ignore[generic.todo_cluster]\nputs 'hello'\n",
}


def repository(spark, changed=None):
    return spark.createDataFrame(sorted((SOURCES | (changed or {})).items()), "path string, text string")


#: What the sources above hold.
EXPECTED = """SELECT rule_id, file_path, CAST(symbol AS VARCHAR) AS symbol, severity, CAST(confidence AS DOUBLE) AS confidence, message, CAST(line AS INTEGER) AS line FROM (VALUES
('generic.todo_cluster', 'lib/widget.rb', NULL, 'info', 0.8, '3 marker lines', 1),
('go.duplicate_literal', 'srv/main.go', substr(sha256('listening on port'), 1, 12), 'info', 0.8, 'literal used 4 times', 13),
('go.large_function', 'srv/main.go', 'Serve', 'warning', 0.9, '57 lines', 17),
('go.missing_nearby_test', 'srv/main.go', NULL, 'warning', 0.6, 'no test file in the directory', NULL),
('next.route_handler_too_much', 'web/route.ts', 'GET', 'warning', 0.75, '48 lines', 1),
('python.assertion_free_test', 'tests/test_alpha.py', 'test_runs', 'warning', 0.8, 'assertion_free test', 8),
('python.dead_code_candidate', 'src/app/gamma.py', 'unused_helper', 'info', 0.6, 'not used anywhere', 8),
('python.dead_code_candidate', 'src/app/large.py', 'load_all', 'info', 0.6, 'not used anywhere', 1),
('python.dead_code_candidate', 'src/app/large.py', 'parse_all', 'info', 0.6, 'not used anywhere', 70),
('python.dead_code_candidate', 'src/app/large.py', 'save_all', 'info', 0.6, 'not used anywhere', 66),
('python.dead_code_candidate', 'src/app/mixed.py', 'load_rows', 'info', 0.6, 'not used anywhere', 1),
('python.dead_code_candidate', 'src/app/mixed.py', 'render_rows', 'info', 0.6, 'not used anywhere', 9),
('python.dead_code_candidate', 'src/app/mixed.py', 'save_rows', 'info', 0.6, 'not used anywhere', 5),
('python.dead_code_candidate', 'src/app/shapes.py', 'Box', 'info', 0.6, 'not used anywhere', 17),
('python.dead_code_candidate', 'src/app/shapes.py', 'first', 'info', 0.6, 'not used anywhere', 1),
('python.dead_code_candidate', 'src/app/shapes.py', 'second', 'info', 0.6, 'not used anywhere', 9),
('python.deep_nesting', 'src/app/shapes.py', NULL, 'warning', 0.75, 'depth 5', NULL),
('python.duplicate_literal', 'src/app/large.py', substr(sha256('repeated literal'), 1, 12), 'info', 0.85, 'literal used 4 times', 74),
('python.import_cycle', 'src/app/alpha.py', NULL, 'warning', 0.9, 'cycle of 3', NULL),
('python.large_file', 'src/app/mixed.py', NULL, 'warning', 0.9, '310 lines', NULL),
('python.large_function', 'src/app/large.py', 'load_all', 'warning', 0.9, '63 lines', 1),
('python.missing_nearby_test', 'src/app/beta.py', NULL, 'info', 0.65, 'no test file for this module', NULL),
('python.missing_nearby_test', 'src/app/gamma.py', NULL, 'info', 0.65, 'no test file for this module', NULL),
('python.missing_nearby_test', 'src/app/large.py', NULL, 'info', 0.65, 'no test file for this module', NULL),
('python.missing_nearby_test', 'src/app/mixed.py', NULL, 'info', 0.65, 'no test file for this module', NULL),
('python.missing_nearby_test', 'src/app/shapes.py', NULL, 'info', 0.65, 'no test file for this module', NULL),
('python.mixed_responsibilities', 'src/app/mixed.py', NULL, 'info', 0.55, '3 kinds of work', NULL),
('python.no_op_test', 'tests/test_alpha.py', 'test_nothing', 'warning', 0.8, 'no_op test', 4),
('python.no_op_test', 'tests/test_alpha.py', 'test_true', 'warning', 0.8, 'no_op test', 12),
('python.over_mocked_test', 'tests/test_alpha.py', 'test_mocked', 'warning', 0.7, 'over_mocked test', 18),
('python.structural_near_duplicate', 'src/app/shapes.py', 'first', 'info', 0.8, 'same shape as 1 more', 1),
('python.todo_cluster', 'src/app/large.py', NULL, 'info', 0.9, '3 marker lines', 71),
('react.too_many_hooks', 'web/Panel.tsx', 'Panel', 'info', 0.7, '9 hooks', 13),
('react.too_many_props', 'web/Panel.tsx', NULL, 'info', 0.65, '9 props', NULL),
('typescript.assertion_free_test', 'web/route.test.ts', 'does nothing', 'warning', 0.7, 'assertion_free test', 1),
('typescript.duplicate_literal', 'web/Panel.tsx', substr(sha256('panel-main'), 1, 12), 'info', 0.7, 'literal used 2 times', 23),
('typescript.missing_nearby_test', 'web/Panel.tsx', NULL, 'info', 0.65, 'no test file beside it', NULL),
('typescript.no_op_test', 'web/route.test.ts', 'later', 'warning', 0.7, 'no_op test', 4),
('typescript.todo_cluster', 'web/route.ts', NULL, 'info', 0.8, '2 marker lines', 49)) t(rule_id, file_path, symbol, severity, confidence, message, line)"""
