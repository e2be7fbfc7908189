from plasmaspark.plans.commands import main

main()
