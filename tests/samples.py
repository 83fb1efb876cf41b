"""A small source tree for tests: cyclic, aliased, relative and wildcard imports, nested classes and functions, decorators, coroutines, a file that doesn't parse."""

FILES = {
    "setup_kiln.py": (
        "import kiln.glaze as glazing\n"
        "from kiln.tools.timer import Timer as Clock\n"
        "from kiln.tools.timer import wait\n"
        "\n"
        "LIMIT = max(3, 5)\n"
        "\n"
        "\n"
        "async def start(pots, *, hot=True):\n"
        "    clock = Clock(pots)\n"
        "    await wait(clock)\n"
        "    return [glazing.coat(p) for p in pots]\n"
    ),
    "docs/notes.txt": "Not a source file.\n",
    "kiln/__init__.py": "from .fire import *\n",
    "kiln/fire.py": (
        "import asyncio\n"
        "import kiln.glaze\n"
        "\n"
        "\n"
        "class Kiln:\n"
        '    """Heats."""\n'
        "\n"
        "    class Door:\n"
        "        def open(self):\n"
        "            return self.swing()\n"
        "\n"
        "        def swing(self):\n"
        "            pass\n"
        "\n"
        "    def __init__(self, size=1):\n"
        "        self.door = Kiln.Door()\n"
        "\n"
        "    @property\n"
        "    def heat(self):\n"
        "        return round(900.5)\n"
        "\n"
        "\n"
        "def light():\n"
        "    def spark():\n"
        "        return Kiln()\n"
        "\n"
        "    return kiln.glaze.coat(spark())\n"
    ),
    "kiln/glaze.py": "from kiln import fire\n\n\nclass Glaze(fire.Kiln, dict):\n    pass\n\n\ndef coat(pot):\n    return Glaze(pot)\n",
    "kiln/tools/__init__.py": "",
    "kiln/tools/broken.py": "def (:\n",
    "kiln/tools/timer.py": (
        "import asyncio as aio\n"
        "from functools import wraps\n"
        "\n"
        "\n"
        'def timed(name="x"):\n'
        "    def outer(f):\n"
        "        @wraps(f)\n"
        "        async def inner(*args):\n"
        "            return await f(*args)\n"
        "\n"
        "        return inner\n"
        "\n"
        "    return outer\n"
        "\n"
        "\n"
        '@timed("wait")\n'
        "async def wait(clock):\n"
        "    await aio.sleep(clock.left)\n"
        "\n"
        "\n"
        "class Timer:\n"
        '    left = len("abc")\n'
        "\n"
        "    def __init__(self, pots):\n"
        "        self.pots = sorted(pots)\n"
    ),
}


def write(root, files=None):
    for path, text in (files or FILES).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return root
