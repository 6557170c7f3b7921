"""python -m cubeloom <command>"""

from cubeloom.cli import main

main()
