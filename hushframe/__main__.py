import sys

from hushframe.cli import main

sys.exit(main(sys.argv[1:]))
