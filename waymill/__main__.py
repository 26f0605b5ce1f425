from waymill.plans.modes import main

main()
