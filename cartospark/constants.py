"""Tag vocabularies and numeric tables of OpenStreetMap analysis. All of these are fixed values."""

from __future__ import annotations


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# --- Fixed values: Earth radii in metres, and metres in a degree of latitude.
R_MEAN, R_ROUND, M_PER_DEG = 6371008.8, 6371000.0, 111320.0

# --- Fixed values: amenity groups of semantic extraction.
AMENITY_GROUPS = {
    "food_drink": _w("restaurant fast_food cafe pub bar food_court ice_cream biergarten juice_bar coffee_shop"),
    "shopping": _w("marketplace supermarket convenience department_store mall vending_machine kiosk"),
    "services": _w("bank atm post_office pharmacy hospital clinic dentist doctors veterinary social_facility childcare nursing_home bureau_de_change money_transfer lawyer insurance estate_agent"),
    "education": _w("school university college library kindergarten language_school music_school driving_school training research_institute"),
    "transport": _w("fuel charging_station car_wash car_rental taxi bus_station parking parking_space parking_entrance bicycle_parking bicycle_rental bicycle_repair_station motorcycle_parking boat_rental ferry_terminal car_sharing"),
    "entertainment": _w("cinema theatre nightclub casino arts_centre community_centre social_centre events_venue conference_centre exhibition_centre planetarium studio gambling dive_centre"),
    "tourism": _w("hotel guest_house hostel motel attraction camp_site caravan_site chalet alpine_hut wilderness_hut information tourism"),
    "public": _w("toilets drinking_water shower bench waste_basket waste_disposal recycling fountain water_point clock post_box telephone bbq shelter hunting_stand"),
    "emergency": _w("police fire_station ambulance_station rescue_station coast_guard mountain_rescue lifeguard emergency_phone"),
    "civic": _w("townhall courthouse embassy prison ranger_station register_office tax_office customs public_building"),
    "religious": _w("place_of_worship monastery grave_yard crematorium funeral_hall"),
    "healthcare": _w("hospital clinic doctors dentist pharmacy veterinary blood_donation nursing_home baby_hatch healthcare optician physiotherapist psychotherapist"),
}
# --- Fixed values: highway and building groups of semantic extraction.
HIGHWAY_GROUPS = {
    "major": _w("motorway trunk primary secondary tertiary"),
    "local": _w("residential unclassified service living_street"),
    "pedestrian": _w("pedestrian footway steps path cycleway"),
    "special": _w("bus_guideway busway raceway track"),
}
BUILDING_GROUPS = {
    "residential": _w("residential apartments house detached terrace semi semidetached_house semi_detached bungalow dormitory flats flat cabin hut static_caravan home villa townhouse townhouses units unit duplex triplex"),
    "commercial": _w("commercial office industrial retail warehouse supermarket kiosk hotel motel service store shop storage_tank factory manufacture"),
    "public": _w("public school hospital government civic college university kindergarten library fire_station police train_station transportation sports_centre stadium community_centre prison military toilets museum sports_hall swimming_pool theatre cinema courthouse hall clubhouse pub mixed civic_centre arena"),
    "religious": _w("religious church mosque temple synagogue chapel cathedral shrine monastery convent"),
    "agricultural": _w("farm farm_auxiliary barn stable sty cowshed greenhouse glasshouse slurry_tank silo granary"),
    "other": _w("yes building other garage garages carport shed roof canopy construction ruins abandoned hangar pavilion grandstand bunker shelter boathouse houseboat annexe outbuilding container kiosk cabin gatehouse guardhouse tower bridge transformer_tower water_tower tank storage parking portable demountable prefabricated modular tent gazebo pergola veranda porch deckhouse utility"),
}
# --- Fixed values: tags kept as feature properties.
IMPORTANT_TAGS = _w("name addr:street addr:housenumber addr:city addr:postcode addr:country alt_name official_name website phone email opening_hours cuisine brand operator network surface maxspeed lanes oneway lit sidewalk height levels building:levels roof:material roof:shape description note access wheelchair")
ROAD_TAGS = _w("name ref maxspeed lanes surface oneway lit sidewalk access toll bridge tunnel width layer")
BUILDING_TAGS = _w("name height levels building:levels building:material roof:shape roof:material addr:street addr:housenumber addr:postcode addr:city start_date architect operator")
AMENITY_TAGS = _w("name brand operator opening_hours phone website email cuisine addr:street addr:housenumber addr:postcode addr:city wheelchair capacity fee access description")
# --- Fixed values: speeds in km/h where maxspeed is not tagged: extraction, network table, routing modes.
EXTRACT_SPEEDS = {"motorway": 110, "motorway_link": 80, "trunk": 80, "trunk_link": 60, "primary": 60, "primary_link": 50, "secondary": 50, "secondary_link": 40, "tertiary": 50, "tertiary_link": 40, "residential": 40, "unclassified": 40, "service": 20, "living_street": 20, "pedestrian": 10, "footway": 5, "cycleway": 20, "path": 10, "track": 30}
NETWORK_SPEEDS = {"motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35, "tertiary": 40, "tertiary_link": 30, "residential": 30, "living_street": 20, "unclassified": 30, "service": 20, "road": 30, "track": 15, "path": 5, "footway": 5, "cycleway": 15, "pedestrian": 5, "steps": 3}
MODE_SPEEDS = {
    "walk": {"default": 5, "steps": 3, "path": 4, "footway": 5, "pedestrian": 5, "residential": 5, "living_street": 5},
    "walk_map": {"default": 5, "steps": 3, "path": 4, "footway": 5, "pedestrian": 5, "residential": 5, "living_street": 5, "primary": 4, "secondary": 4, "tertiary": 5, "service": 5, "unclassified": 5, "track": 4},
    "bike": {"default": 15, "cycleway": 18, "path": 12, "residential": 15, "tertiary": 18, "secondary": 20, "primary": 15},
    "drive": {"motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35, "tertiary": 40, "tertiary_link": 30, "residential": 30, "living_street": 20, "unclassified": 30, "service": 20, "default": 30},
}
# --- Fixed values: roads open to each mode.
MODE_ROADS = {
    "walk": _w("primary secondary tertiary residential living_street unclassified service pedestrian footway path steps track"),
    "walk_map": _w("primary secondary tertiary residential living_street unclassified service pedestrian footway path steps track"),
    "bike": _w("primary secondary tertiary residential living_street unclassified service cycleway path track"),
    "drive": _w("motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link residential living_street unclassified service road"),
    "all": tuple(NETWORK_SPEEDS),
}
# --- Fixed values: road hierarchy levels and presets, infrastructure overlays.
ROAD_LEVELS = {
    1: _w("motorway motorway_link"), 2: _w("trunk trunk_link primary primary_link"), 3: _w("secondary secondary_link tertiary tertiary_link"),
    4: _w("residential unclassified living_street"), 5: _w("service track road"), 6: _w("pedestrian footway cycleway path steps bridleway"),
}
ROAD_PRESETS = {"motorway": (1,), "arterial": (1, 2), "main": (1, 2, 3), "driveable": (1, 2, 3, 4, 5), "all": (1, 2, 3, 4, 5, 6)}
INFRASTRUCTURE = {
    "bridges": ("bridge", _w("yes viaduct aqueduct cantilever covered movable trestle suspension simple arch boardwalk low_water_crossing")),
    "tunnels": ("tunnel", _w("yes culvert building_passage covered avalanche_protector")),
    "fords": ("ford", _w("yes stepping_stones boat")),
    "embankments": ("embankment", _w("yes")),
    "covered": ("covered", _w("yes arcade colonnade pergola")),
}
# --- Fixed values: road classes, surfaces, administrative levels.
ROAD_CLASSES = {
    "major": _w("motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link"),
    "minor": _w("tertiary tertiary_link residential unclassified living_street service road"),
    "path": _w("footway cycleway path pedestrian track bridleway steps corridor"),
}
SURFACES = {
    "paved": _w("asphalt concrete paving_stones sett cobblestone metal wood paved"),
    "unpaved": _w("unpaved compacted fine_gravel gravel pebblestone dirt earth mud sand grass ground"),
    "special": _w("rubber tartan artificial_turf clay ice snow"),
}
ADMIN_LEVELS = {"2": "country", "3": "region", "4": "state", "5": "region", "6": "county", "7": "municipality", "8": "city", "9": "district", "10": "suburb", "11": "neighbourhood"}
# --- Fixed values: POI categories by key, first match in this order.
POI = {
    "food": {"amenity": _w("restaurant cafe fast_food bar pub food_court ice_cream biergarten bakery"), "shop": _w("bakery butcher cheese chocolate coffee confectionery convenience deli farm frozen_food greengrocer health_food organic pasta pastry seafood spices tea wine supermarket grocery")},
    "shop": {"shop": _w("supermarket convenience clothes shoes electronics hardware furniture department_store mall books toys sports jewelry optician beauty cosmetics gift florist mobile_phone computer bicycle car car_parts tyres doityourself garden_centre")},
    "health": {"amenity": _w("hospital clinic doctors dentist pharmacy veterinary nursing_home health_centre"), "healthcare": _w("hospital clinic doctor dentist pharmacy physiotherapist optometrist laboratory")},
    "education": {"amenity": _w("school university college kindergarten library language_school music_school driving_school childcare")},
    "transport": {"amenity": _w("bus_station ferry_terminal taxi car_rental bicycle_rental car_sharing fuel charging_station parking"), "highway": _w("bus_stop"), "railway": _w("station halt tram_stop subway_entrance"), "aeroway": _w("aerodrome terminal helipad")},
    "tourism": {"tourism": _w("hotel motel hostel guest_house apartment museum gallery attraction viewpoint zoo theme_park aquarium artwork information camp_site"), "amenity": _w("theatre cinema arts_centre nightclub casino community_centre"), "leisure": _w("park playground stadium sports_centre swimming_pool golf_course ice_rink beach_resort")},
    "finance": {"amenity": _w("bank atm bureau_de_change money_transfer")},
    "service": {"amenity": _w("post_office police fire_station courthouse townhall embassy community_centre social_facility recycling waste_disposal toilets shower"), "office": _w("government lawyer notary estate_agent insurance employment_agency travel_agent")},
    "worship": {"amenity": _w("place_of_worship")},
}
# --- Fixed values: categories of single-key extractions.
AMENITY = {
    "food": _w("restaurant cafe fast_food bar pub food_court ice_cream biergarten nightclub"),
    "education": _w("school university college kindergarten library language_school music_school driving_school training"),
    "health": _w("hospital clinic doctors dentist pharmacy veterinary nursing_home social_facility"),
    "transport": _w("parking fuel bus_station taxi car_rental car_wash bicycle_parking bicycle_rental charging_station ferry_terminal"),
    "finance": _w("bank atm bureau_de_change money_transfer"),
    "public": _w("townhall courthouse police fire_station post_office community_centre social_centre prison"),
    "worship": _w("place_of_worship"),
    "entertainment": _w("cinema theatre casino arts_centre studio"),
    "service": _w("toilets shower drinking_water telephone bench waste_basket recycling vending_machine photo_booth"),
}
SHOP = {
    "food": _w("supermarket convenience grocery bakery butcher greengrocer deli cheese seafood alcohol wine beverages coffee tea confectionery chocolate pastry"),
    "clothing": _w("clothes fashion boutique shoes jewelry watches bag leather tailor fabric"),
    "electronics": _w("electronics computer mobile_phone hifi appliance electrical camera"),
    "health": _w("pharmacy chemist medical_supply optician hearing_aids herbalist nutrition_supplements"),
    "home": _w("furniture kitchen bed bathroom_furnishing carpet curtain interior_decoration houseware antiques"),
    "diy": _w("doityourself hardware paint glaziery garden_centre trade building_materials"),
    "sports": _w("sports outdoor bicycle fishing hunting golf scuba_diving swimming_pool"),
    "beauty": _w("beauty cosmetics hairdresser perfumery tattoo"),
    "car": _w("car car_parts car_repair tyres motorcycle"),
    "other": _w("gift toys games books newsagent stationery pet florist variety_store second_hand charity kiosk"),
}
FOOD = _w("restaurant cafe fast_food bar pub biergarten food_court ice_cream nightclub")
CUISINES = {
    "asian": _w("asian chinese japanese korean thai vietnamese indian indonesian malaysian filipino sushi ramen noodle curry dim_sum"),
    "european": _w("italian french german spanish greek portuguese polish russian british irish mediterranean pizza pasta"),
    "american": _w("american mexican tex-mex brazilian peruvian burger steak bbq barbecue southern"),
    "middle_eastern": _w("middle_eastern turkish lebanese persian arabic kebab falafel shawarma"),
    "fast_food": _w("burger pizza chicken sandwich fish_and_chips hot_dog donut bagel"),
    "other": _w("international regional seafood vegetarian vegan organic breakfast brunch coffee_shop cake dessert"),
}
HEALTHCARE = {
    "hospital": _w("hospital clinic"), "doctor": _w("doctors doctor general_practitioner"),
    "specialist": _w("dentist optometrist physiotherapist psychologist psychiatrist podiatrist chiropractor dermatologist cardiologist neurologist gynecologist urologist pediatrician geriatrician oncologist radiologist"),
    "pharmacy": _w("pharmacy chemist"), "emergency": _w("emergency urgent_care"),
    "other": _w("nursing_home hospice blood_donation dialysis rehabilitation laboratory sample_collection vaccination_centre"),
}
HEALTHCARE_AMENITY = _w("hospital clinic doctors dentist pharmacy veterinary")
EDUCATION = {
    "school": _w("school primary secondary high_school"), "higher": _w("university college"), "preschool": _w("kindergarten childcare nursery"),
    "specialized": _w("language_school music_school driving_school dance_school cooking_school art_school surf_school"), "other": _w("library training research_institute"),
}
EDUCATION_AMENITY = _w("school university college kindergarten library language_school music_school driving_school childcare")
TOURISM = {
    "accommodation": _w("hotel motel hostel guest_house apartment chalet alpine_hut wilderness_hut camp_site caravan_site camp_pitch"),
    "attraction": _w("attraction theme_park zoo aquarium museum gallery artwork viewpoint"), "information": _w("information map board guidepost office"), "other": _w("picnic_site trail_riding_station wine_cellar"),
}
LEISURE = {
    "parks": _w("park garden nature_reserve dog_park"), "sports": _w("pitch sports_centre stadium track golf_course swimming_pool ice_rink fitness_centre horse_riding"),
    "recreation": _w("playground fitness_station disc_golf_course miniature_golf water_park beach_resort amusement_arcade"), "culture": _w("marina bandstand dance hackerspace"),
}
NATURAL = {
    "landform": _w("peak hill volcano valley ridge saddle cliff cave_entrance rock stone scree sinkhole arch"), "vegetation": _w("wood tree tree_row scrub heath grassland fell tundra bare_rock shingle"),
    "water": _w("water bay strait spring hot_spring geyser wetland glacier reef"), "coastal": _w("beach coastline shoal cape peninsula isthmus"),
}
WATER = {"natural": _w("water bay beach coastline spring hot_spring"), "waterway": _w("river stream canal drain ditch waterfall dam"), "water": _w("lake pond reservoir basin lagoon river canal"), "landuse": _w("reservoir basin")}
LANDUSE = {
    "residential": _w("residential apartments houses"), "commercial": _w("commercial retail office"), "industrial": _w("industrial warehouse port"), "agricultural": _w("farmland orchard vineyard meadow farmyard"),
    "recreation": _w("recreation_ground park playground sports_centre"), "institutional": _w("education institutional religious cemetery"), "natural": _w("forest grass wood scrub heath"),
    "infrastructure": _w("railway highway parking"), "other": _w("construction brownfield greenfield landfill quarry"),
}
HISTORIC = {
    "monument": _w("monument memorial statue bust stone plaque milestone boundary_stone"), "building": _w("castle manor palace fort tower city_gate church monastery mosque temple synagogue ruins archaeological_site"),
    "military": _w("battlefield bomb_crater bunker cannon tank aircraft ship wreck"), "industrial": _w("mine quarry adit mine_shaft locomotive railway_car mill charcoal_pile kiln lime_kiln"),
    "other": _w("tomb grave cemetery gallows pillory wayside_cross wayside_shrine yes"),
}
EMERGENCY = {
    "services": _w("ambulance_station fire_station police mountain_rescue water_rescue air_rescue coast_guard rescue_station"), "medical": _w("hospital clinic doctors pharmacy defibrillator first_aid_kit emergency_ward"),
    "infrastructure": _w("fire_hydrant fire_extinguisher fire_alarm fire_hose emergency_phone phone siren assembly_point access_point landing_site"), "safety": _w("life_ring lifeguard lifeguard_tower safety_shower eye_wash emergency_ward_entrance"),
}
BARRIER = {
    "linear": _w("fence wall hedge retaining_wall guard_rail handrail kerb city_wall ditch cable_barrier"), "access": _w("gate lift_gate swing_gate toll_booth border_control entrance cattle_grid stile turnstile kissing_gate full-height_turnstile sally_port"),
    "blocking": _w("bollard block jersey_barrier planter log chain rope debris tank_trap"), "traffic": _w("bump hump table cushion rumble_strip chicane island kerb"),
}
SPORT = {
    "ball": _w("soccer football basketball tennis volleyball baseball cricket rugby hockey handball netball badminton squash table_tennis golf bowling"),
    "water": _w("swimming diving water_polo surfing sailing rowing canoeing kayaking kitesurfing windsurfing scuba_diving fishing"), "fitness": _w("fitness gym yoga pilates crossfit weightlifting bodybuilding aerobics dance"),
    "cycling": _w("cycling bmx mountain_biking motocross"), "athletics": _w("athletics running marathon triathlon long_jump high_jump shot_put javelin discus"), "combat": _w("boxing wrestling judo karate taekwondo martial_arts fencing aikido kendo"),
    "winter": _w("skiing ice_skating ice_hockey curling snowboarding cross_country_skiing biathlon"), "other": _w("climbing bouldering horse_racing equestrian skateboarding archery shooting paragliding"),
}
RAIL_LINES = _w("rail light_rail subway tram monorail narrow_gauge preserved miniature funicular")
RAIL_STATIONS = _w("station halt stop")
# --- Fixed values: (key, value, transit type, feature type), first match.
TRANSIT = (
    ("highway", "bus_stop", "bus", "stop"), ("railway", "station", "rail", "station"), ("railway", "halt", "rail", "halt"), ("railway", "tram_stop", "tram", "stop"), ("railway", "subway_entrance", "subway", "entrance"),
    ("amenity", "bus_station", "bus", "station"), ("amenity", "ferry_terminal", "ferry", "terminal"), ("public_transport", "stop_position", "transit", "stop"), ("public_transport", "platform", "transit", "platform"), ("public_transport", "station", "transit", "station"),
)
# --- Fixed values: feature typing of named elements, first match, and importance.
NAME_KEYS = (("place", _w("city town village suburb hamlet neighbourhood")), ("highway", _w("motorway trunk primary secondary tertiary residential")), ("amenity", None), ("shop", None), ("tourism", None), ("building", _w("yes residential commercial")), ("natural", None), ("landuse", None))
IMPORTANCE = {("place", "city"): 10, ("place", "town"): 9, ("place", "village"): 7, ("place", "suburb"): 6, ("highway", "motorway"): 8, ("highway", "primary"): 6, ("railway", "station"): 7, ("amenity", "hospital"): 6, ("amenity", "university"): 6, ("tourism", "attraction"): 5}
# --- Fixed values: traffic safety features (name, key, value).
SAFETY = (
    ("traffic_signals", "highway", "traffic_signals"), ("crossings", "highway", "crossing"), ("stop_signs", "highway", "stop"), ("give_way_signs", "highway", "give_way"), ("speed_cameras", "highway", "speed_camera"), ("street_lamps", "highway", "street_lamp"), ("toll_gantries", "highway", "toll_gantry"),
    ("traffic_calming_table", "traffic_calming", "table"), ("traffic_calming_hump", "traffic_calming", "hump"), ("traffic_calming_bump", "traffic_calming", "bump"), ("traffic_calming_island", "traffic_calming", "island"), ("traffic_calming_cushion", "traffic_calming", "cushion"), ("traffic_calming_choker", "traffic_calming", "choker"), ("traffic_calming_chicane", "traffic_calming", "chicane"), ("traffic_calming_rumble_strip", "traffic_calming", "rumble_strip"),
    ("barriers_bollard", "barrier", "bollard"), ("barriers_guard_rail", "barrier", "guard_rail"), ("barriers_jersey_barrier", "barrier", "jersey_barrier"), ("barriers_cycle_barrier", "barrier", "cycle_barrier"), ("barriers_height_restrictor", "barrier", "height_restrictor"),
    ("emergency_phone", "emergency", "phone"), ("emergency_defibrillator", "emergency", "defibrillator"), ("emergency_fire_hydrant", "emergency", "fire_hydrant"), ("emergency_life_ring", "emergency", "life_ring"), ("surveillance", "man_made", "surveillance"),
)
# --- Fixed values: cycling features (name, element, key, values, further key, further values).
CYCLING = (
    ("cycleways", "way", "highway", _w("cycleway"), None, ()), ("shared_paths", "way", "highway", _w("path bridleway"), "bicycle", _w("designated yes permissive")),
    ("roads_with_cycle_lanes", "way", "cycleway", _w("lane track shared_lane share_busway shoulder separate"), None, ()), ("roads_bicycle_designated", "way", "bicycle", _w("designated"), "highway", _w("residential tertiary secondary primary unclassified service")),
    ("bicycle_parking", "node", "amenity", _w("bicycle_parking"), None, ()), ("bicycle_rental", "node", "amenity", _w("bicycle_rental"), None, ()), ("bicycle_repair", "node", "amenity", _w("bicycle_repair_station"), None, ()), ("bicycle_shops", "node", "shop", _w("bicycle"), None, ()),
)
# --- Fixed values: POI categories of catchments ("*": any value).
CATCHMENT = {
    "healthcare": {"amenity": _w("hospital clinic doctors dentist pharmacy"), "healthcare": ("*",)}, "education": {"amenity": _w("school kindergarten college university library")},
    "food": {"amenity": _w("restaurant cafe fast_food bar pub food_court"), "shop": _w("supermarket convenience grocery bakery butcher")}, "shopping": {"shop": _w("mall department_store clothes shoes electronics")},
    "services": {"amenity": _w("bank atm post_office police fire_station")}, "transit": {"amenity": _w("bus_station"), "railway": _w("station halt tram_stop"), "public_transport": _w("station stop_position platform")},
    "leisure": {"leisure": _w("park playground sports_centre fitness_centre swimming_pool"), "amenity": _w("cinema theatre community_centre")},
}
# --- Fixed values: walkability.
WALK_WEIGHTS = {"pedestrian_infrastructure": 0.25, "intersection_density": 0.20, "amenity_access": 0.25, "transit_access": 0.10, "greenspace": 0.10, "safety_features": 0.10}
WALK_AMENITIES = {
    "food": _w("restaurant cafe fast_food bar pub bakery ice_cream"), "shopping": _w("supermarket convenience clothes shoes department_store"), "services": _w("bank atm post_office pharmacy doctors dentist hospital toilets"), "education": _w("school kindergarten library college university"),
    "leisure": _w("park playground sports_centre fitness_centre cinema theatre"), "transit": _w("bus_stop tram_stop subway_entrance train_station bus_station"), "furniture": _w("bench waste_basket drinking_water"), "cycling": _w("bicycle_parking"), "worship": _w("place_of_worship"),
}
PEDESTRIAN_WAYS = _w("footway pedestrian path steps living_street")
WALK_GRADES = ((90, "A+", "Walker's Paradise"), (80, "A", "Very Walkable"), (70, "B", "Walkable"), (60, "C", "Somewhat Walkable"), (50, "D", "Car-Dependent"), (None, "F", "Very Car-Dependent"))
# --- Fixed values: bikeability.
BIKE_WEIGHTS = {"dedicated_infrastructure": 0.25, "intersection_safety": 0.15, "road_quality": 0.15, "network_connectivity": 0.15, "traffic_separation": 0.10, "bike_facilities": 0.10, "traffic_calming": 0.05, "topography": 0.05}
BIKE_ROADS = {"cycleway": 100, "path": 70, "living_street": 80, "pedestrian": 60, "residential": 50, "tertiary": 40, "secondary": 25, "primary": 15, "trunk": 5, "motorway": 0}
BIKE_LANES = _w("lane track share_busway shared_lane shoulder opposite opposite_lane opposite_track")
CAR_DANGER = {"motorway": 100, "motorway_link": 95, "trunk": 90, "trunk_link": 85, "primary": 80, "primary_link": 75, "secondary": 60, "secondary_link": 55, "tertiary": 40, "tertiary_link": 35, "unclassified": 25, "residential": 15, "service": 10, "living_street": 5}
SURFACE_SCORES = {"asphalt": 100, "paved": 95, "concrete": 90, "paving_stones": 75, "compacted": 60, "fine_gravel": 50, "gravel": 40, "dirt": 30, "grass": 20, "sand": 10, "cobblestone": 35}
BARRIER_PENALTIES = {"gate": 30, "lift_gate": 25, "swing_gate": 25, "bollard": 10, "cycle_barrier": 15, "block": 40, "jersey_barrier": 50, "fence": 60, "wall": 80, "kerb": 5, "cattle_grid": 35, "stile": 70, "turnstile": 60, "chain": 20, "step": 50, "debris": 40}
PARKING_SCORES = {"stands": 60, "rack": 55, "wall_loops": 50, "wide_stands": 70, "building": 95, "shed": 85, "lockers": 90, "garage": 90, "two-tier": 65, "floor": 40, "informal": 20, "anchors": 45}
KERB_PENALTIES = {"flush": 0, "lowered": 5, "raised": 30, "rolled": 15, "regular": 40}
HGV_DANGER = {"designated": 80, "yes": 60, "delivery": 40, "destination": 30, "agricultural": 20, "no": 0}
BIKE_GRADES = ((90, "A+", "Cyclist's Paradise"), (80, "A", "Excellent for Cycling"), (70, "B", "Very Bikeable"), (60, "C", "Bikeable"), (50, "D", "Somewhat Bikeable"), (None, "F", "Not Bike-Friendly"))
# --- Fixed values: building heights in metres by type.
BUILDING_HEIGHTS = {"house": 8, "residential": 12, "apartments": 20, "commercial": 15, "retail": 6, "industrial": 10, "warehouse": 8, "garage": 3, "shed": 3, "roof": 4, "church": 15, "cathedral": 30, "hospital": 18, "school": 10, "university": 15, "office": 25, "hotel": 20, "skyscraper": 100, "tower": 40}
# --- Fixed values: keys that make a closed way an area; address keys; descriptions (key, text around the value), first match.
AREA_KEYS = _w("building landuse natural area leisure amenity shop tourism")
ADDRESS_KEYS = _w("housenumber housename street unit city suburb postcode state country full")
DESCRIPTIONS = (("amenity", "", ""), ("shop", "", " shop"), ("highway", "", " road"), ("building", "building (", ")"), ("tourism", "", ""), ("leisure", "", ""), ("natural", "", ""), ("landuse", "", " area"), ("place", "", ""))
