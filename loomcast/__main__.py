from loomcast.cli import main

raise SystemExit(main())
