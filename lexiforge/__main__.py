import sys

from lexiforge.cli import main

sys.exit(main(sys.argv[1:]))
