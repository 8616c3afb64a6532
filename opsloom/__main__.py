"""Entry point: ``python -m opsloom <command>`` or ``spark-submit`` of this file."""

import sys

from opsloom.commands import main
from opsloom.session import build_session

if __name__ == "__main__":
    main(build_session(), sys.argv[1:])
